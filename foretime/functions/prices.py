"""Prices: American and decimal odds, implied and fair probabilities, fees, stakes and settlement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied(american: Column) -> Column:
    """The probability that a price implies; zero and NULL give NULL."""
    a = american.cast("double")
    return F.when(a < 0, -a / (100 - a)).when(a > 0, 100 / (100 + a))


def decimal_odds(american: Column) -> Column:
    a = american.cast("double")
    return F.when(a < 0, 1 - 100 / a).when(a > 0, 1 + a / 100)


def american_odds(decimal: Column) -> Column:
    """Rounded half to even; NULL at 1 and below."""
    d = decimal.cast("double")
    return F.when(d >= 2, F.bround((d - 1) * 100)).when(d > 1, F.bround(-100 / (d - 1))).cast("int")


def fair(own: Column, other: Column) -> Column:
    """Own share of the two implied probabilities: the margin is taken out in proportion."""
    return implied(own) / (implied(own) + implied(other))


def overround(a: Column, b: Column) -> Column:
    return implied(a) + implied(b) - 1


def exchange_fee(venue: Column, price: Column, coefficients: dict[str, float]) -> Column:
    """coefficient * q * (1 - q) at the venues that charge it, else 0."""
    out = F.lit(0.0)
    for name, c in coefficients.items():
        out = F.when(venue == name, c * price * (1 - price)).otherwise(out)
    return out


def effective_decimal(american: Column, venue: Column, coefficients: dict[str, float]) -> Column:
    """Decimal odds after the venue's fee."""
    q = implied(american)
    return F.when(venue.isin(list(coefficients)), 1 / (q + exchange_fee(venue, q, coefficients))).otherwise(decimal_odds(american))


def expected_value(p: Column, decimal: Column) -> Column:
    return p * decimal - 1


def kelly(p: Column, decimal: Column) -> Column:
    """The growth-optimal stake as a share of the bankroll; never negative."""
    return F.greatest(((decimal - 1) * p - (1 - p)) / (decimal - 1), F.lit(0.0))


def decide(p_home: Column, fair_home: Column, home: Column, away: Column, edge_min: float = 0.025, part: float = 0.25, cap: float = 0.02) -> Column:
    """struct(side, edge, stake) of the first side that qualifies, HOME before AWAY: its edge over the fair price is at least edge_min and its Kelly stake positive; else NULL."""

    def side(name: str, p: Column, market: Column, price: Column) -> Column:
        k = kelly(p, decimal_odds(price))
        return F.when(
            (p - market >= edge_min) & (k > 0),
            F.struct(F.lit(name).alias("side"), (p - market).alias("edge"), F.least(k * part, F.lit(cap)).alias("stake")),
        )

    return F.coalesce(side("HOME", p_home, fair_home, home), side("AWAY", 1 - p_home, 1 - fair_home, away))


def profit(won: Column, stake: Column, decimal: Column) -> Column:
    """NULL won is a push."""
    return F.when(won.isNull(), F.lit(0.0)).when(won, stake * (decimal - 1)).otherwise(-stake)


def hedge_free_bet(bonus: Column, dec_bonus: Column, dec_hedge: Column) -> Column:
    """struct(hedge, profit) of a free bet whose stake isn't returned, hedged on the other side."""
    hedge = bonus * (dec_bonus - 1) / dec_hedge
    return F.struct(hedge.alias("hedge"), (hedge * (dec_hedge - 1)).alias("profit"))


def hedge_risk_free(stake: Column, dec_bonus: Column, dec_hedge: Column, refund: float = 0.7) -> Column:
    """struct(hedge, profit) of a stake that comes back as credit worth refund of it when it loses."""
    hedge = stake * (dec_bonus - refund) / dec_hedge
    return F.struct(hedge.alias("hedge"), (stake * (dec_bonus - 1) - hedge).alias("profit"))


def hedge_boost(stake: Column, dec_bonus: Column, boost: Column, dec_hedge: Column) -> Column:
    """struct(hedge, profit) of a profit boost."""
    paid = 1 + (dec_bonus - 1) * (1 + boost)
    hedge = stake * paid / dec_hedge
    return F.struct(hedge.alias("hedge"), (stake * (paid - 1) - hedge).alias("profit"))


def parlay(decimals: Column, results: Column) -> Column:
    """struct(status, factor) of a slip from parallel arrays of decimal odds and WIN, LOSS, PUSH, VOID or NULL: any loss loses, an open leg keeps it open, pushed and void legs count as 1."""
    factors = F.zip_with(decimals, results, lambda d, r: F.when(r == "WIN", d).otherwise(F.lit(1.0)))
    lost = F.exists(results, lambda r: F.coalesce(r == "LOSS", F.lit(False)))
    open_ = F.exists(results, lambda r: r.isNull())
    live = F.exists(results, lambda r: F.coalesce(r == "WIN", F.lit(False)))
    status = F.when(lost, "LOST").when(open_, "OPEN").when(live, "WON").otherwise("PUSH")
    return F.struct(status.alias("status"), F.aggregate(factors, F.lit(1.0), lambda a, x: a * x).alias("factor"))


def slip_cash(status: Column, stake: Column, factor: Column, bonus: Column) -> Column:
    """Cash result of a slip; a bonus stake is neither lost nor returned."""
    return (
        F.when(status == "WON", stake * (factor - 1))
        .when(status == "LOST", F.when(bonus, F.lit(0.0)).otherwise(-stake))
        .when(status == "PUSH", F.lit(0.0))
    )


def closing_value(close: Column, placed: Column, fair_close: Column, fair_placed: Column) -> Column:
    """Closing-line value to 4 places: by the same venue's price if it closed there, else by the fair consensus."""
    return F.round(F.coalesce(implied(close) - implied(placed), fair_close - fair_placed), 4)


def void_reason(state: Column, start: Column, scheduled: Column, final: Column | None = None, issued: Column | None = None, shift: str = "3 hours", move: str = "36 hours") -> Column:
    """Why a bet is void: postponed or cancelled; or, once the game is final, moved: its start is more than shift from the one it was scheduled for, or, where that isn't known, more than move after the bet was issued. NULL where it stands."""
    final = F.lit(True) if final is None else final
    far = (start > scheduled + F.expr(f"INTERVAL {shift}")) | (start < scheduled - F.expr(f"INTERVAL {shift}"))
    late = F.lit(False) if issued is None else scheduled.isNull() & (start > issued + F.expr(f"INTERVAL {move}"))
    return F.when(state.isin("PPD", "CNCL"), F.lower(state)).when(final & (F.coalesce(far, F.lit(False)) | F.coalesce(late, F.lit(False))), "moved")


def middle_breakeven(dec_over: Column, dec_under: Column) -> Column:
    """The chance of the middle at which the pair breaks even if every other outcome pays the worse single winner."""
    worst = F.least(dec_over, dec_under) - 2
    return -worst / (dec_over + dec_under - 2 - worst)


def after_slippage(guaranteed: Column, slippage: float = 0.01) -> Column:
    """A guarantee net of price movement between the legs."""
    return guaranteed * F.lit(1 - slippage)


def on_scale(american: Column) -> Column:
    """American prices as one scale without the gap between -100 and 100."""
    return F.when(american < 0, american + 100).otherwise(american - 100)


def cents_apart(a: Column, b: Column) -> Column:
    """a minus b on that scale: positive where a pays more."""
    return on_scale(a) - on_scale(b)


def points_apart(a: Column, b: Column) -> Column:
    """Implied chances, a minus b, in percentage points."""
    return (implied(a) - implied(b)) * 100
