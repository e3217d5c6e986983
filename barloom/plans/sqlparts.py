"""Shared SQL: the inputs and feature families as common table expressions for the SQL side."""

TICKS = """
ticks AS (
  SELECT event_type AS key, event_id AS seq, ts, value AS price,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec
  FROM events)"""

BARS = (
    TICKS
    + """,
bars AS (
  SELECT key, CAST(3600 AS INTEGER) AS tf_sec, sec // 3600 * 3600 AS bar_epoch,
         arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, count(*) AS n_ticks, CAST(1 AS DOUBLE) AS volume
  FROM ticks GROUP BY ALL)"""
)

VOLUME_BARS = """
bars AS (
  SELECT l_returnflag AS key, CAST(86400 AS INTEGER) AS tf_sec,
         CAST(epoch(l_shipdate) AS BIGINT) // 86400 * 86400 AS bar_epoch,
         arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS close,
         count(*) AS n_ticks, sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL)"""

NUMBERED = """,
b AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY bar_epoch) - 1 AS rn,
         high - low AS spread, abs(close - open) AS body
  FROM bars)"""


def with_(*parts: str) -> str:
    return "WITH " + "".join(parts)


def w(n: int, to: int = 0) -> str:
    """Row frame from n - 1 rows before up to `to` rows before the current one."""
    end = "CURRENT ROW" if to == 0 else f"{to} PRECEDING"
    return f"OVER (PARTITION BY key ORDER BY bar_epoch ROWS BETWEEN {n - 1} PRECEDING AND {end})"


S = "OVER (PARTITION BY key ORDER BY bar_epoch)"
"""The whole series in order, for lag and lead."""


def strict(fn: str, column: str, n: int) -> str:
    """Aggregate over the last n rows, null before n values are there."""
    return f"CASE WHEN count({column}) {w(n)} = {n} THEN {fn}({column}) {w(n)} END"


def ema(column: str, span: int) -> str:
    """Exponential average started at the first value."""
    alpha = 2.0 / (span + 1.0)
    return (
        f"list_reduce(list({column}) OVER (PARTITION BY key ORDER BY bar_epoch "
        f"ROWS UNBOUNDED PRECEDING), lambda a, v: a * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE)"
    )


def rd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE) + 1e-11::DOUBLE, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


def ii(*names: str) -> str:
    return ", ".join(f"coalesce(CAST({n} AS INTEGER), 0) AS {n}" for n in names)


def _rsi(n: int) -> str:
    gain, loss = strict("avg", "gain", n), strict("avg", "loss", n)
    return f"100 - 100 / (1 + ({gain}) / (({loss}) + 1e-10::DOUBLE))"


def _sql_ema_columns() -> str:
    return ", ".join(f"{ema('close', n)} AS ema_{n}" for n in (5, 10, 20, 50, 200, 12, 26))


# The indicator family, step by step over b. Written with nullable columns; `feat` fills them.
INDICATORS = (
    NUMBERED
    + f""",
f1 AS (SELECT *, spread + 1e-10::DOUBLE AS sp, lag(close) {S} AS pc,
  close - lag(close) {S} AS delta, {_sql_ema_columns()},
  greatest(coalesce(high - lag(high) {S}, 0), 0) AS upm,
  greatest(coalesce(lag(low) {S} - low, 0), 0) AS dnm,
  {strict('avg', 'close', 5)} AS sma_5, {strict('avg', 'close', 10)} AS sma_10, {strict('avg', 'close', 20)} AS sma_20,
  {strict('stddev_samp', 'close', 20)} AS std20,
  {strict('max', 'high', 14)} AS hi14, {strict('min', 'low', 14)} AS lo14,
  ({strict('avg', 'volume', 20)}) + 1e-10::DOUBLE AS usual,
  {strict('sum', 'volume', 20)} AS vol20 FROM b),
f2 AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain,
  CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss,
  CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN upm < dnm THEN 0 ELSE upm END AS plus_dm, CASE WHEN dnm < upm THEN 0 ELSE dnm END AS minus_dm,
  ema_12 - ema_26 AS macd, close * volume AS cv, sign(delta) * volume AS signed,
  sma_20 + 2 * std20 AS bb_upper, sma_20 - 2 * std20 AS bb_lower,
  100 * (close - lo14) / (hi14 - lo14 + 1e-10::DOUBLE) AS stoch_k,
  -100 * (hi14 - close) / (hi14 - lo14 + 1e-10::DOUBLE) AS williams_r FROM f1),
f3 AS (SELECT *, {ema('macd', 9)} AS macd_signal, {_rsi(7)} AS rsi_7, {_rsi(14)} AS rsi_14, {_rsi(21)} AS rsi_21,
  {strict('avg', 'tr', 14)} AS atr_14, {strict('avg', 'tr', 10)} AS atr_10,
  {strict('avg', 'plus_dm', 14)} AS pdm14, {strict('avg', 'minus_dm', 14)} AS mdm14,
  (bb_upper - bb_lower) / (sma_20 + 1e-10::DOUBLE) AS bb_width,
  (close - bb_lower) / (bb_upper - bb_lower + 1e-10::DOUBLE) AS bb_pos,
  {strict('avg', 'stoch_k', 3)} AS stoch_d, {strict('sum', 'cv', 20)} AS cv20 FROM f2),
f4 AS (SELECT *, macd - macd_signal AS macd_hist, {strict('avg', 'bb_width', 20)} AS width20,
  100 * pdm14 / (atr_14 + 1e-10::DOUBLE) AS plus_di, 100 * mdm14 / (atr_14 + 1e-10::DOUBLE) AS minus_di,
  {strict('avg', 'atr_14', 20)} AS atr_m20, {strict('avg', 'atr_14', 50)} AS atr_m50 FROM f3),
f5 AS (SELECT *, plus_di - minus_di AS di_diff,
  100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-10::DOUBLE) AS dx FROM f4),
f6 AS (SELECT *, {strict('avg', 'dx', 14)} AS adx_14 FROM f5),
ind AS (SELECT *,
  body / sp AS body_pct, body / sp AS body_ratio, (high - greatest(close, open)) / sp AS upper_wick_ratio,
  (least(close, open) - low) / sp AS lower_wick_ratio,
  coalesce(CAST(lag(close, 1) {S} > lag(open, 1) {S} AS INTEGER), 0) AS prev_1_green,
  coalesce(CAST(lag(close, 2) {S} > lag(open, 2) {S} AS INTEGER), 0) AS prev_2_green,
  coalesce(CAST(lag(close, 3) {S} > lag(open, 3) {S} AS INTEGER), 0) AS prev_3_green,
  coalesce(CAST(lag(close, 4) {S} > lag(open, 4) {S} AS INTEGER), 0) AS prev_4_green,
  (close - ema_5) / (close + 1e-10::DOUBLE) AS c_vs_ema5, (close - ema_20) / (close + 1e-10::DOUBLE) AS c_vs_ema20,
  (close - sma_20) / (close + 1e-10::DOUBLE) AS c_vs_sma20,
  (ema_5 - ema_20) / (close + 1e-10::DOUBLE) AS ema5_vs_ema20,
  (ema_10 - ema_50) / (close + 1e-10::DOUBLE) AS ema10_vs_ema50,
  (ema_5 - lag(ema_5, 3) {S}) / (close + 1e-10::DOUBLE) AS ema5_slope,
  (ema_20 - lag(ema_20, 5) {S}) / (close + 1e-10::DOUBLE) AS ema20_slope,
  rsi_14 - lag(rsi_14, 3) {S} AS rsi_slope, macd_hist - lag(macd_hist, 2) {S} AS macd_hist_slope,
  stoch_k - lag(stoch_k, 2) {S} AS stoch_slope,
  (close - sma_20) / (0.015::DOUBLE * std20 + 1e-10::DOUBLE) AS cci_20,
  (close / lag(close, 3) {S} - 1) * 100 AS roc_3, (close / lag(close, 5) {S} - 1) * 100 AS roc_5,
  (close / lag(close, 10) {S} - 1) * 100 AS roc_10,
  close > lag(close, 5) {S} AS dir_5bar, close > lag(close, 10) {S} AS dir_10bar, close > lag(close, 20) {S} AS dir_20bar,
  atr_14 / (close + 1e-10::DOUBLE) AS atr_pct, sma_20 AS bb_middle, bb_width < width20 * 0.8::DOUBLE AS bb_squeeze,
  ema_20 + 2 * atr_10 AS keltner_upper, ema_20 - 2 * atr_10 AS keltner_lower,
  atr_14 / (atr_m50 + 1e-10::DOUBLE) AS atr_regime, atr_14 > atr_m20 * 1.5::DOUBLE AS regime_volatile,
  adx_14 > 25 AS regime_trend, adx_14 < 20 AS regime_range,
  volume / usual AS volume_ratio, volume > usual * 2 AS volume_spike,
  coalesce(sum(signed) OVER (PARTITION BY key ORDER BY bar_epoch ROWS UNBOUNDED PRECEDING), 0) AS obv,
  cv20 / (vol20 + 1e-10::DOUBLE) AS vwap,
  volume > usual * 1.5::DOUBLE AND close > open AS vsa_high_vol_bull,
  volume > usual * 1.5::DOUBLE AND close < open AS vsa_high_vol_bear,
  volume < usual * 0.7::DOUBLE AND close > open AS vsa_low_vol_up,
  volume < usual * 0.7::DOUBLE AND close < open AS vsa_low_vol_down,
  sp / (volume + 1e-10::DOUBLE) AS vsa_spread_vs_vol, ((close - low) / sp - 0.5::DOUBLE) * volume AS delta_approx,
  CAST(bar_epoch % 86400 // 3600 AS INTEGER) AS utc_hour,
  CAST((bar_epoch // 86400 + 4) % 7 + 1 AS INTEGER) AS day_of_week FROM f6),
feat AS (SELECT *, prev_1_green + prev_2_green + prev_3_green AS consec_green,
  3 - (prev_1_green + prev_2_green + prev_3_green) AS consec_red,
  utc_hour >= 7 AND utc_hour < 16 AS london_session, utc_hour >= 12 AND utc_hour < 21 AS ny_session,
  utc_hour < 8 AS asian_session, utc_hour >= 12 AND utc_hour < 16 AS overlap_session FROM ind)"""
)
