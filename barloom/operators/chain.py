"""The signal chain with feedback: what was settled before decides what may be sent next."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.learning import BASE, CEILING, MIN_SAMPLES, SLACK, STEP_DOWN, STEP_UP, TARGET
from barloom.operators.scoring import GRADES
from barloom.operators.signals import PLACE_SCORES
from barloom.operators.voting import AGENTS

# Rows before a series is analysed, losses that stop it, signals and bars of a window, seconds between two
# diagnoses, days of outcomes they look at for hours and for confidence bands, and their limits.
MIN_ROWS, BREAK, KEEP, WINDOW_BARS = 149, 5, 3, 5
DIAGNOSE_EVERY, HOUR_DAYS, BAND_DAYS, MIN_SETTLED, BAD_HOUR, BAD_BAND = 21600, 7, 14, 8, 0.42, 0.50
RECENT, MIN_TRADES, CAP = 30, 5, 0.99
DAY = 86400

_COLUMNS = "key tf_sec at rn side confidence adx range_index in_news agreement net close votes ballots".split()
_OUT = (
    "key string, tf_sec int, at bigint, settled string, streak int, multiplier double, threshold double, block_reason string, "
    "final_side int, final_confidence double, grade string, agreement_share double, conflict double, score double"
)


def session_number(hour: int) -> int:
    return 0 if 8 <= hour < 13 else 1 if 13 <= hour < 17 else 2 if 17 <= hour < 21 else 3


def volatility_number(adx: float) -> int:
    return 0 if adx < 18 else 1 if adx < 28 else 2


def band(confidence: float) -> int:
    return 0 if confidence >= 0.90 else 1 if confidence >= 0.80 else 2 if confidence >= 0.70 else 3


def grade_of(confidence: float) -> str:
    return next((name for name, least in GRADES if confidence >= least), "SKIP")


@dataclass
class Sent:
    """The signal that waits for the next bar's close."""

    at: int
    side: int
    confidence: float
    votes: Sequence[int]


@dataclass
class Series:
    """What a series has learnt so far. Its size does not grow with the series: outcomes are kept for 14 days at most."""

    threshold: list[float] = field(default_factory=lambda: [BASE] * 12)
    record: list[list[int]] = field(default_factory=lambda: [[0, 0] for _ in range(12)])
    streak: int = 0
    trades: list[int] = field(default_factory=lambda: [0] * len(AGENTS))
    recent: list[deque] = field(default_factory=lambda: [deque(maxlen=RECENT) for _ in AGENTS])
    multiplier: dict[int, float] = field(default_factory=dict)
    outcomes: deque = field(default_factory=deque)
    diagnosed: int | None = None
    sent: Sent | None = None
    close: float = 0.0
    window: int = -1
    scores: list[float] = field(default_factory=list)

    def weight(self, agent: int) -> float:
        if self.trades[agent] < MIN_TRADES:
            return 1.0
        return max(0.20, min(2.0, 1 + (sum(self.recent[agent]) / len(self.recent[agent]) - 0.5) * 4))

    def settle(self, at: int, tf: int, close: float, index: float) -> str | None:
        """Outcome of the signal of the bar before, and all that is learnt from it. A signal whose next bar is missing lapses."""
        sent, self.sent = self.sent, None
        if sent is None or sent.at != at - tf:
            return None
        move = (close > self.close) - (close < self.close)
        if move == 0:
            return "EXPIRED"
        won = move == sent.side
        self.streak = 0 if won else self.streak + 1
        hour = sent.at % DAY // 3600
        bucket = session_number(hour) * 3 + volatility_number(index)
        record = self.record[bucket]
        record[not won] += 1
        total = sum(record)
        if total >= MIN_SAMPLES:
            rate = record[0] / total
            if rate < TARGET:
                self.threshold[bucket] = min(self.threshold[bucket] + STEP_UP, CEILING)
            elif rate > TARGET + SLACK:
                self.threshold[bucket] = max(self.threshold[bucket] - STEP_DOWN, BASE)
        for agent, vote in enumerate(sent.votes):
            if vote:
                self.trades[agent] += 1
                self.recent[agent].append((vote == sent.side) == won)
        self.outcomes.append((at + tf, hour, band(sent.confidence), won))
        return "WIN" if won else "LOSS"

    def diagnose(self, now: int) -> None:
        """Every few hours: hours that lost too often step down, then each over-confident band scales all listed hours."""
        if self.diagnosed is not None and now - self.diagnosed < DIAGNOSE_EVERY:
            return
        self.diagnosed = now
        while self.outcomes and self.outcomes[0][0] < now - BAND_DAYS * DAY:
            self.outcomes.popleft()
        hours: dict[int, list[int]] = {}
        bands: dict[int, list[int]] = {}
        for settled, hour, level, won in self.outcomes:
            for table, name, known in ((hours, hour, settled >= now - HOUR_DAYS * DAY), (bands, level, True)):
                if known:
                    entry = table.setdefault(name, [0, 0])
                    entry[0] += won
                    entry[1] += 1
        for hour, (wins, total) in hours.items():
            if total >= MIN_SETTLED and wins / total < BAD_HOUR:
                self.multiplier[hour] = max(0.70, self.multiplier.get(hour, 1.0) - 0.04)
        for wins, total in bands.values():
            if total >= MIN_SETTLED and wins / total < BAD_BAND:
                self.multiplier = {h: max(0.70, m * 0.97) for h, m in self.multiplier.items()}

    def agents(self, side: int, confidence: float, votes: Sequence[int], ballots: Sequence[float]) -> tuple[int, float, float, float]:
        """Side and confidence after critic and vote; share that agrees and conflict."""
        agree = oppose = neutral = green = red = 0.0
        for agent, (vote, ballot) in enumerate(zip(votes, ballots, strict=True)):
            w = self.weight(agent) * ballot
            agree += w if vote == side else 0.0
            oppose += w if vote == -side else 0.0
            neutral += w if vote == 0 else 0.0
            green += w if vote == 1 else 0.0
            red += w if vote == -1 else 0.0
        neutral *= 0.5
        whole = agree + oppose + neutral
        share = (agree + neutral * 0.5) / (whole if whole > 0 else 1.0)
        if share >= 0.75:
            value = min(confidence * (1 + (share - 0.75) * 0.40), CAP)
        elif share >= 0.60:
            value = min(confidence * 1.05, CAP)
        else:
            value = confidence * (0.90 if share >= 0.40 else 0.75)
        value = value * (0.90 if votes[3] == -side else 1.0) * (0.85 if votes[0] == votes[1] == -side else 1.0)
        value = min(value, CAP)
        cast = green + red if green + red > 0 else 1.0
        final = 1 if green / cast >= 0.55 else -1 if red / cast >= 0.55 else side
        n_green, n_red = votes.count(1), votes.count(-1)
        conflict = 1 - max(n_green, n_red) / (n_green + n_red) if n_green + n_red >= 2 else 0.0
        value = value * (0.93 if final != side else 1.0) * (1 - conflict * 0.25 if conflict > 0.35 else 1.0)
        return final, min(value, CAP), share, conflict

    def place(self, at: int, tf: int, score: float) -> bool:
        """True if a signal gets into its window: a free place, or a better score than the worst one there."""
        number = at // (tf * WINDOW_BARS)
        if number != self.window:
            self.window, self.scores = number, []
        if len(self.scores) < KEEP:
            self.scores.append(score)
            return True
        worst = min(range(KEEP), key=self.scores.__getitem__)
        if score <= self.scores[worst]:
            return False
        self.scores[worst] = score
        return True

    def step(self, at, tf, rn, side, confidence, adx, index, in_news, agreement, net, close, votes, ballots, floor) -> tuple:
        """One bar: settle, diagnose, then the gates in order."""
        settled = self.settle(at, tf, close, index)
        self.close = close
        self.diagnose(at + tf)
        hour = at % DAY // 3600
        factor = self.multiplier.get(hour, 1.0)
        threshold = self.threshold[session_number(hour) * 3 + volatility_number(adx)]
        value = max(0.0, min(confidence * factor, CAP))
        final, final_value, share, conflict, score, reason = None, None, None, None, None, None
        if rn < MIN_ROWS:
            reason = "min_history"
        elif in_news:
            reason = "news"
        elif value < floor:
            reason = "low_score"
        elif value < threshold:
            reason = "below_threshold"
        elif self.streak >= BREAK:
            reason = "circuit_breaker"
        else:
            final, final_value, share, conflict = self.agents(side, value, votes, ballots)
            if final_value < floor:
                reason = "agents_below_threshold"
            else:
                place = at // tf % WINDOW_BARS
                score = agreement * 40 + PLACE_SCORES[place] * 0.20 + (net if final == 1 else -net) * 0.25 + final_value * 15
                if not self.place(at, tf, score):
                    reason = "window_full"
        if reason is None:
            self.sent = Sent(at, final, final_value, votes)
        grade = None if final_value is None else grade_of(final_value)
        return settled, self.streak, factor, threshold, reason, final, final_value, grade, share, conflict, score


def signal_chain(rows: DataFrame, floor: float = dict(GRADES)["MODERATE"]) -> DataFrame:
    """Every bar's gates, agents, window and settlement, each decided on what its series had settled by then.

    rows: key, tf_sec, bar_start, rn, direction, confidence (without what is learnt), adx (nullable), range_index, in_news,
    agreement, net, close, votes (1, 0, -1 in the order of AGENTS) and ballots (regime boost x confidence of each vote).
    Adds settled (outcome of the signal of the bar before), streak, multiplier, threshold (as of this bar, of its own bucket),
    block_reason (null: the signal is sent), final_direction, final_confidence, grade, agreement_share, conflict and score.

    Bar time decides, settlement time teaches: a signal is known to have won or lost when the next bar closes, and enters
    thresholds, streak, voters' records and hours there; so no row depends on its own outcome. That order is a series' own, so
    a series is a run of one task: its rows come sorted by a shuffle that spills, one narrow row a bar after all features and
    votes were made in parallel, and pass one at a time. The task holds the state of one series and one batch of rows.
    """
    side = F.when(F.col("direction") == "GREEN", 1).otherwise(-1)
    named = {"at": F.unix_timestamp("bar_start"), "side": side, "adx": F.coalesce(F.col("adx"), F.lit(0.0)), "tf_sec": F.col("tf_sec").cast("int")}
    ordered = rows.withColumns(named).select(*_COLUMNS).repartition("key", "tf_sec").sortWithinPartitions("key", "tf_sec", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = Series(), None
        for batch in batches:
            out = []
            for key, tf, at, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, tf) != current:
                    state, current = Series(), (key, tf)
                out.append((key, tf, at, *state.step(at, tf, *rest, floor)))
            fields = [f.split() for f in _OUT.split(", ")]
            kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
            columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)] if out else [pa.array([], kinds[k]) for _, k in fields]
            yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

    done = ordered.mapInArrow(run, _OUT)
    turned = F.when(F.col("final_side") == 1, "GREEN").when(F.col("final_side") == -1, "RED")
    kept = [c for c in done.columns if c not in ("key", "tf_sec", "at", "final_side")]
    return done.select("key", "tf_sec", F.timestamp_seconds("at").alias("bar_start"), turned.alias("final_direction"), *kept)


def ballots(votes: DataFrame, proposals: DataFrame, boosts: DataFrame) -> DataFrame:
    """key, bar_start, votes and ballots in the order of AGENTS, for `signal_chain`, from one row a vote."""
    asked = proposals.select("key", "bar_start", "vote_regime")
    number = F.coalesce(*(F.when(F.col("agent") == name, i) for i, name in enumerate(AGENTS)))
    side = F.when(F.col("vote") == "GREEN", 1).when(F.col("vote") == "RED", -1).otherwise(0)
    cast = votes.join(asked, ["key", "bar_start"]).join(boosts, ["vote_regime", "agent"], "left")
    entry = F.struct(number.alias("agent"), side.alias("vote"), (F.coalesce("boost", F.lit(1.0)) * F.col("confidence")).alias("ballot"))
    listed = cast.groupBy("key", "bar_start").agg(F.array_sort(F.collect_list(entry)).alias("cast"))
    return listed.select("key", "bar_start", F.col("cast.vote").alias("votes"), F.col("cast.ballot").alias("ballots"))


def sent(chain: DataFrame) -> Column:
    return F.col("block_reason").isNull()


def outcomes(chain: DataFrame) -> DataFrame:
    """Sent signals with their outcome: the one that the next bar's row has settled; null while there is none."""
    settled = chain.filter(F.col("settled").isNotNull())
    before = F.timestamp_seconds(F.unix_timestamp("bar_start") - F.col("tf_sec"))
    known = settled.select("key", "tf_sec", before.alias("bar_start"), F.col("settled").alias("outcome"))
    return chain.filter(sent(chain)).drop("settled").join(known, ["key", "tf_sec", "bar_start"], "left")
