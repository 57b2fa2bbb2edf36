"""Implausible readings per source, by a hidden Markov model with hard bounds, and the exact rules after it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators.medians import exact_medians
from tickforge.sources.shared import write_shared

#: States of the model, and the chance of each next state before a source is known; each source's own chances are then
#: fitted to its readings, with PRIOR steps' weight on these. Scales are the source's own from the begin.
NORMAL, SPIKE, STUCK, OUT = range(4)
TRANSITION = np.array([[0.9875, 0.01, 0.0005, 0.002], [0.5, 0.497, 0.001, 0.002], [0.03, 0.002, 0.966, 0.002], [0.9, 0.05, 0.01, 0.04]])
PRIOR = 200.0
#: Posterior probability from which a reading is a candidate; the exact rules follow, so it is low.
CANDIDATE = 0.02
#: Share of a source's approximate median from which the thresholds of spreads and ratios are screened. Every reading that
#: may reach its threshold is told, whatever the posterior; sources whose exact median is below the share are read again.
SCREEN = 0.5
#: Readings of a segment of a source; at most SEGMENTS per source, beyond that segments grow.
SEGMENT, SEGMENTS = 16_384, 1_000
#: Neighbouring readings that a segment sees beyond its ends, and the longest spike.
HALO, LONGEST_SPIKE = 12, 5
#: Steps of one forward-backward pass, and the overlap on either side.
CHUNK, OVERLAP = 256, 32
#: Readings handled at once in a task.
BLOCK = 200_000

_IN = "e string, seg int, t bigint, id bigint, v1 double, v2 double, crossed boolean, scale double, halo boolean"
_OUT = "kind tinyint, e string, field tinyint, seg int, id bigint, run bigint, a double, b double, n bigint"
IMPOSSIBLE, JUMP, RUN, MEMBER, VALUE, COUNT = range(6)
INNER, FIRST, LAST, WHOLE = range(4)
LEVEL, SPREAD, RATIO = range(3)  #: kinds of readings: a level in time, a positive spread, a signed ratio


@dataclass(frozen=True)
class Rules:
    """Thresholds of the exact check. Defaults are those of the market data."""

    least_readings: tuple[int, int, int] = (40, 40, 30)
    jump: tuple[float, float, float] = (25.0, 6.0, 10.0)
    stuck_factor: float = 3.0
    stuck_ratio_run: int = 5
    bound: float = 20_000.0


def implausible(quotes: DataFrame, divergences: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(source_table, record_id, field_name) of implausible readings.

    ``quotes``: quote_id, venue, symbol, bid_price, ask_price, mid, spread_bps, event_time_us; ``divergences``:
    divergence_id, symbol, venue_a, venue_b, divergence_bps, event_time_us; spellings canonical. Readings of a source go
    by event_time_us, of rows with one time the smallest id alone; rows with a time of 0 or less or null, and null
    readings, are passed over. Rows without a symbol form a source of their own per venue. Empty tables give nothing.

    A source's readings are cut at approximate quantiles of time into segments of about ``SEGMENT`` readings, so a hot
    source is spread over tasks; a segment sees the ``HALO`` readings before and after it. In each segment the model's
    forward-backward probabilities (states: normal, spike, stuck, out of range) give the candidates; impossible readings
    are fixed to the state out of range by the hard bounds. Where a rule doesn't depend on the model (runs of equal ratios,
    spreads and ratios at their thresholds), every such reading is a candidate. The exact rules then use the medians and run lengths of
    the whole source, put together from value counts and from the runs at the segments' ends.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    q = quotes.where("event_time_us > 0").select(
        F.concat_ws("\x01", F.lit("q"), text("venue"), text("symbol")).alias("e"), F.col("event_time_us").alias("t"), F.col("quote_id").alias("id"),
        F.col("mid").alias("v1"), F.col("spread_bps").alias("v2"), (~F.coalesce(F.col("ask_price") >= F.col("bid_price"), F.lit(False))).alias("crossed"),
    )
    pair = [F.least(text("venue_a"), text("venue_b")), F.greatest(text("venue_a"), text("venue_b"))]
    d = divergences.where("event_time_us > 0").select(
        F.concat_ws("\x01", F.lit("d"), text("symbol"), *pair).alias("e"), F.col("event_time_us").alias("t"), F.col("divergence_id").alias("id"),
        F.col("divergence_bps").alias("v1"), F.lit(None).cast("double").alias("v2"), F.lit(False).alias("crossed"),
    )
    rows = q.unionByName(d)
    found = _exact(rows, _model(rows, rules), rules)
    table = F.when(F.col("e").startswith("q"), F.lit("quotes")).otherwise(F.lit("divergences"))
    field = F.when(F.col("field") == RATIO, "divergence_bps").when(F.col("field") == SPREAD, "spread_bps").otherwise("mid")
    return found.select(table.alias("source_table"), F.col("id").alias("record_id"), field.alias("field_name"))


# --- the model ---------------------------------------------------------------------------------------------------


def _model(rows: DataFrame, rules: Rules) -> DataFrame:
    """What the segments tell (see _OUT), written to the shared folder, as it is read several times."""
    spark = rows.sparkSession
    sized = F.when(F.col("e").startswith("q"), F.col("v2")).otherwise(F.abs("v1"))
    usual = F.percentile_approx(F.when((sized > 0) & (sized <= rules.bound), sized), 0.5, 1000).alias("scale")
    sources = rows.groupBy("e").agg(F.count(F.lit(1)).alias("n"), usual)
    segments = F.least(F.lit(SEGMENTS), F.ceil(F.col("n") / SEGMENT)).cast("int")
    sources = spark.read.parquet(write_shared(sources.withColumn("segments", segments), "sources"))
    # cuts only for sources of several segments; 10,000 is the accuracy of the quantiles, so a segment can't be empty
    grid = [i / SEGMENTS for i in range(1, SEGMENTS)]
    big = sources.where("segments > 1").select("e", "segments")
    cuts = (
        rows.join(big, "e").groupBy("e", "segments").agg(F.percentile_approx("t", grid, 10_000).alias("g"))
        .select("e", F.expr(f"array_distinct(transform(sequence(1, segments - 1), i -> g[cast(i * {SEGMENTS} div segments as int) - 1]))").alias("cuts"))
    )
    cuts = spark.read.parquet(write_shared(cuts.withColumn("tops", F.expr("filter(cuts, (c, i) -> i % 32 = 31)")), "cuts"))
    info = sources.join(cuts, "e", "left").select("e", "scale", "cuts", "tops")
    # a row's segment is the number of cuts before it, found among every 32nd cut and then between two of those
    top = "32 * size(filter(tops, c -> c < t))"
    seg = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.expr(f"{top} + size(filter(slice(cuts, {top} + 1, 32), c -> c < t))"))
    placed = (
        rows.join(info, "e")
        .withColumn("seg", seg)
        .select("e", "seg", "t", "id", "v1", "v2", "crossed", "scale", F.lit(False).alias("halo"), F.col("cuts").isNotNull().alias("cut"))
    )
    core = placed.drop("cut")
    ordered = lambda df: df.repartition("e", "seg").sortWithinPartitions("e", "seg", "t", "id")
    ends = ordered(placed.where("cut").drop("cut")).mapInArrow(_ends, _IN)
    halos = ends.groupBy("e").applyInPandas(_neighbours, _IN)
    return spark.read.parquet(write_shared(ordered(core.unionByName(halos)).mapInArrow(_judge(rules), _OUT), "judged"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole segments, about ``BLOCK`` rows of them at once; of rows with one time, the first."""

    def once(rows: pa.Table) -> pa.Table:
        t, starts = rows["t"].to_numpy(), _bounds(rows)[0]
        first = np.r_[True, t[1:] != t[:-1]]
        first[starts] = True
        return rows.filter(pa.array(first)).combine_chunks()

    held: list[pa.Table] = []
    n, enough = 0, BLOCK
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n >= enough:
            rows = pa.concat_tables(held).combine_chunks()
            last = int(_bounds(rows)[0][-1])  # the last segment may go on
            if last:
                yield once(rows.slice(0, last))
            held, n = [rows.slice(last)], rows.num_rows - last
            enough = n + BLOCK
    if n:
        yield once(pa.concat_tables(held))


def _bounds(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First row of each segment, and the segment's number of each row."""
    e, s = rows["e"].combine_chunks() if isinstance(rows["e"], pa.ChunkedArray) else rows["e"], rows["seg"].to_numpy()
    new = np.ones(rows.num_rows, bool)
    new[1:] = (s[1:] != s[:-1]) | pc.not_equal(e.slice(1), e.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last ``HALO`` readings of each segment."""
    for rows in _segments(batches):
        starts, g = _bounds(rows)
        ends = np.r_[starts[1:], rows.num_rows]
        at = np.arange(rows.num_rows)
        yield from rows.filter(pa.array((at - starts[g] < HALO) | (ends[g] - at <= HALO))).to_batches()


def _neighbours(ends: pd.DataFrame) -> pd.DataFrame:
    """Of one source's segment ends (at most SEGMENTS * 2 * HALO rows), the readings around each segment."""
    ends = ends.sort_values(["t", "id"], ignore_index=True)
    out = []
    for seg, own in ends.groupby("seg").groups.items():
        a, z = own.min(), own.max()
        near = pd.concat([ends.iloc[max(0, a - HALO) : a], ends.iloc[z + 1 : z + 1 + HALO]])
        out.append(near.assign(seg=seg, halo=True))
    return pd.concat(out)[ends.columns]


def forward_backward(emission: np.ndarray, transition: np.ndarray = TRANSITION) -> np.ndarray:
    """Posterior state probabilities of many sequences at once; emission and result: (sequence, step, state).

    ``transition``: one for all, or one per sequence.
    """
    n, steps, k = emission.shape
    next_ = (lambda x: x @ transition) if transition.ndim == 2 else (lambda x: np.einsum("ni,nij->nj", x, transition))
    back_ = (lambda x: x @ transition.T) if transition.ndim == 2 else (lambda x: np.einsum("nj,nij->ni", x, transition))
    forward = np.empty_like(emission)
    state = np.tile(np.array([0.985, 0.01, 0.003, 0.002]), (n, 1))
    for i in range(steps):
        state = (next_(state) if i else state) * emission[:, i]
        state /= np.maximum(state.sum(1, keepdims=True), 1e-300)
        forward[:, i] = state
    back = np.ones((n, k))
    for i in range(steps - 1, -1, -1):
        forward[:, i] *= back
        forward[:, i] /= np.maximum(forward[:, i].sum(1, keepdims=True), 1e-300)
        back = back_(back * emission[:, i])
        back /= np.maximum(back.sum(1, keepdims=True), 1e-300)
    return forward


def fitted(post: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Transition chances per sequence, as its posteriors have them beside PRIOR steps of the shared ones."""
    same = g[1:] == g[:-1]
    counts = np.empty((n, 4, 4))
    for i in range(4):
        for j in range(4):
            counts[:, i, j] = np.bincount(g[1:][same], weights=post[:-1, i][same] * post[1:, j][same], minlength=n)
    counts += PRIOR * TRANSITION
    return counts / counts.sum(2, keepdims=True)


def _posteriors(emission: np.ndarray, starts: np.ndarray, transitions: np.ndarray | None = None) -> np.ndarray:
    """Posteriors along sequences that begin at ``starts``, in overlapping chunks of equal length."""
    n = len(emission)
    ends = np.r_[starts[1:], n]
    first = np.concatenate([np.arange(a, z, CHUNK) for a, z in zip(starts, ends, strict=True)])
    owner = np.searchsorted(starts, first, "right") - 1
    lo, hi = np.maximum(first - OVERLAP, starts[owner]), np.minimum(first + CHUNK + OVERLAP, ends[owner])
    out = np.empty_like(emission)
    for a in range(0, len(first), 512):
        sl = slice(a, a + 512)
        at = lo[sl, None] + np.arange(CHUNK + 2 * OVERLAP)[None, :]
        real = at < hi[sl, None]
        got = np.where(real[..., None], emission[np.minimum(at, n - 1)], 1.0)  # steps past the end say nothing
        post = forward_backward(got, TRANSITION if transitions is None else transitions[owner[sl]])
        keep = real & (at >= first[sl, None]) & (at < first[sl, None] + CHUNK)
        out[at[keep]] = post[keep]
    return out


def _around(x: np.ndarray, starts: np.ndarray, g: np.ndarray, reach: int) -> np.ndarray:
    """Median of the readings around each one, within its segment."""
    ends = np.r_[starts[1:], len(x)]
    at = np.arange(len(x))[:, None] + np.arange(-reach, reach + 1)[None, :]
    return np.median(x[np.clip(at, starts[g][:, None], ends[g][:, None] - 1)], axis=1)


def nine_digits(x: np.ndarray) -> np.ndarray:
    """Positive numbers at nine significant digits, so that equal changes of prices are equal numbers."""
    unit = 10.0 ** (8 - np.floor(np.log10(np.maximum(x, 1e-290))))
    return np.round(x * unit) / unit


def _judge(rules: Rules):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _segments(batches):
            is_ratio = pc.starts_with(rows["e"], "d").to_numpy()
            for column, kinds in (("v1", (LEVEL, RATIO)), ("v2", (SPREAD,))):
                present = pc.is_valid(rows[column]).to_numpy()
                for kind in kinds:
                    mask = present & (is_ratio == (kind == RATIO))
                    if mask.any():
                        yield from _field(rows.filter(pa.array(mask)).combine_chunks(), column, kind, rules)

    return judge


def _field(rows: pa.Table, column: str, kind: int, rules: Rules) -> Iterator[pa.RecordBatch]:
    x, t, ids, halo = (rows[c].to_numpy() for c in (column, "t", "id", "halo"))
    entity, seg, usual = rows["e"].combine_chunks() if isinstance(rows["e"], pa.ChunkedArray) else rows["e"], rows["seg"].to_numpy(), rows["scale"].to_numpy()
    with np.errstate(invalid="ignore"):
        out = ~np.isfinite(x)
        if kind == LEVEL:
            out |= x <= 0
        elif kind == SPREAD:
            out |= (x > rules.bound) | ((x < 0) & ~rows["crossed"].to_numpy())
        else:
            out |= np.abs(x) > rules.bound
    starts, g = _bounds(rows)

    def emit(what: int, at: np.ndarray, id_=None, run=None, a=None, b=None, n=None) -> pa.RecordBatch:
        k = len(at)
        col = lambda v, ty: pa.nulls(k, ty) if v is None else pa.array(v, ty)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, what, np.int8)), entity.take(pa.array(at)), pa.array(np.full(k, kind, np.int8)), pa.array(seg[at], pa.int32()),
             col(id_, pa.int64()), col(run, pa.int64()), col(a, pa.float64()), col(b, pa.float64()), col(n, pa.int64())],
            names=["kind", "e", "field", "seg", "id", "run", "a", "b", "n"],
        )

    bad = np.flatnonzero(out & ~halo)
    if len(bad):
        yield emit(IMPOSSIBLE, bad, id_=ids[bad])
    ok = np.flatnonzero(~out)
    if not len(ok):
        return
    y, h, gk = x[ok], halo[ok], g[ok]
    new = np.r_[True, gk[1:] != gk[:-1]]
    s0 = np.flatnonzero(new)
    gy = np.cumsum(new) - 1
    ends = np.r_[s0[1:], len(y)]
    step = np.r_[0.0, np.abs(np.diff(y))]
    same = ~new & (step == 0)
    moved = ~new & (step > 0)

    # value counts for the exact medians
    if kind == LEVEL:
        told = np.flatnonzero(moved & ~h)
        value = nine_digits(step[told])
    else:
        told = np.flatnonzero(~h)
        value = np.abs(y[told]) if kind == RATIO else y[told]
    if len(told):
        pairs = pd.DataFrame({"g": gy[told], "v": value}).groupby(["g", "v"], sort=False).size()
        at = ok[s0[pairs.index.get_level_values(0)]]
        yield emit(VALUE, at, a=pairs.index.get_level_values(1).to_numpy(), n=pairs.to_numpy())
    counted = np.bincount(gy[~h], minlength=len(s0))
    screen = SCREEN * np.nan_to_num(usual[ok[s0]])  # without a usual size no reading is above 0
    yield emit(COUNT, ok[s0], a=screen, n=counted)

    # how far a reading is from what is usual, in units of the source
    if kind == LEVEL:
        scale = pd.Series(np.where(moved, step, np.nan)).groupby(gy).median().to_numpy()[gy]
        off = np.abs(y - _around(y, s0, gy, LONGEST_SPIKE))
        width, least = 1.5, 8.0
    else:
        scale = usual[ok]
        off = np.abs(y) if kind == RATIO else np.maximum(y, 0)
        width, least = (1.0, 4.0) if kind == RATIO else (0.7, 3.0)
    known = np.isfinite(scale) & (scale > 0)
    far = np.where(known, off / np.where(known, scale, 1.0), np.where(off > 0, least, 0.0))
    usual_same = np.clip((np.bincount(gy[same], minlength=len(s0)) / np.maximum(1, np.bincount(gy) - 1)), 0.002, 0.95)[gy]

    emission = np.zeros((len(x), 4))
    emission[:, OUT] = out
    normal = np.exp(-np.maximum(far - (kind != LEVEL), 0) / width) / (2 * width) + 1e-30
    jump = np.where(far >= least / 2, 1 / (2 * np.maximum(far, least) * np.log(1e6)), 1e-6)
    emission[ok, NORMAL] = np.where(same, usual_same, 1 - usual_same) * normal
    emission[ok, SPIKE] = np.where(same, 0.05, 0.95) * jump
    emission[ok, STUCK] = np.where(same, 0.999, 0.001) * normal
    post = _posteriors(emission, starts)
    by_source = _posteriors(emission, starts, fitted(post, g, len(starts)))
    # a reading is looked at if either model says so: where a source has no spike yet, its own model hardly expects one
    post = np.maximum(post, by_source)[ok]

    spike = post[:, SPIKE] >= CANDIDATE
    if kind == LEVEL:
        at = np.arange(len(y))
        b = np.maximum.accumulate(np.where(~spike, at, -1))
        a = np.minimum.accumulate(np.where(~spike, at, len(y))[::-1])[::-1]
        spike &= (b >= s0[gy]) & (a < ends[gy]) & (a - b - 1 <= LONGEST_SPIKE)
        hit = np.flatnonzero(spike & ~h)
        up, down = y[hit] - y[b[hit]], y[hit] - y[np.minimum(a[hit], len(y) - 1)]
        margin = np.where(np.sign(up) == np.sign(down), np.minimum(np.abs(up), np.abs(down)), 0.0)
    else:
        size = np.abs(y) if kind == RATIO else y
        spike |= (size > 0) & (size >= rules.jump[kind] * screen[gy])
        hit = np.flatnonzero(spike & ~h)
        margin = size[hit]
    if len(hit):
        yield emit(JUMP, ok[hit], id_=ids[ok[hit]], a=margin)
    if kind == SPREAD:
        return

    # runs of equal readings, of the segment's own readings
    own = np.flatnonzero(~h)
    if not len(own):
        return
    yo, go = y[own], gy[own]
    head = np.r_[True, (go[1:] != go[:-1]) | (yo[1:] != yo[:-1])]
    r0 = np.flatnonzero(head)
    r = np.cumsum(head) - 1
    length = np.diff(np.r_[r0, len(yo)])
    chance = np.maximum.reduceat(post[own, STUCK], r0)
    rg = go[r0]
    is_first, is_last = np.r_[True, rg[1:] != rg[:-1]], np.r_[rg[1:] != rg[:-1], True]
    cut = np.zeros(len(s0), bool)
    np.logical_or.at(cut, gy, h)  # only segments of a divided source have neighbours
    part = np.where(cut[rg], np.where(is_first & is_last, WHOLE, np.where(is_first, FIRST, np.where(is_last, LAST, INNER))), INNER)
    tell = (part != INNER) | (chance >= CANDIDATE)
    if kind == RATIO:
        tell |= length >= rules.stuck_ratio_run
    rows_at, began = ok[own[r0]], t[ok[own[r0]]]
    k = np.flatnonzero(tell)
    if len(k):
        yield emit(RUN, rows_at[k], id_=part[k], run=began[k], a=chance[k], b=yo[r0][k], n=length[k])
    k = np.flatnonzero(~tell)
    if len(k):  # of ordinary runs, the segment's longest
        longest = pd.Series(length[k]).groupby(rg[k]).max()
        yield emit(RUN, ok[s0[longest.index]], id_=np.full(len(longest), INNER), run=np.full(len(longest), -1), a=np.zeros(len(longest)), n=longest.to_numpy())
    k = np.flatnonzero(tell[r])
    if len(k):
        yield emit(MEMBER, ok[own[k]], id_=ids[ok[own[k]]], run=began[r[k]])


# --- the exact rules ---------------------------------------------------------------------------------------------


def _stitch(runs: pd.DataFrame) -> pd.DataFrame:
    """One source's end runs (at most 2 * SEGMENTS): equal neighbours across segments become one run."""
    runs = runs.sort_values(["seg", "run"], ignore_index=True)
    before = runs.shift(1)
    joined = (runs.seg != before.seg) & (runs.b == before.b) & runs.id.isin([FIRST, WHOLE]) & before.id.isin([LAST, WHOLE])
    whole = (~joined).cumsum()
    return runs.assign(n=runs.groupby(whole).n.transform("sum"), a=runs.groupby(whole).a.transform("max"))


def _unscreened(rows: DataFrame, weak: DataFrame, rules: Rules) -> DataFrame:
    """Spreads and ratios at their thresholds, of the sources in ``weak`` (e, field, median), from all their readings."""
    first = rows.join(weak, "e").groupBy("e", "t", "field", "median").agg(F.min(F.struct("id", "v1", "v2", "crossed")).alias("x"))
    size = F.when(F.col("field") == RATIO, F.abs("x.v1")).otherwise(F.col("x.v2"))
    least = F.when(F.col("field") == RATIO, rules.jump[RATIO]).otherwise(rules.jump[SPREAD]) * F.col("median")
    return first.where((size <= rules.bound) & (size >= least)).select("e", "field", F.col("x.id").alias("id"))


def _exact(rows: DataFrame, judged: DataFrame, rules: Rules) -> DataFrame:
    of = lambda kind: judged.where(F.col("kind") == kind)
    by_kind = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("field").cast("int") + 1)
    counts = of(COUNT).groupBy("e", "field").agg(F.sum("n").alias("readings"), F.max("a").alias("screen")).where(F.col("readings") >= by_kind(rules.least_readings))
    medians = exact_medians(of(VALUE), ["e", "field"], "a", "n")
    shared = lambda df, name: rows.sparkSession.read.parquet(write_shared(df, name))
    judges = shared(counts.join(medians, ["e", "field"], "left"), "judges")
    weak = shared(judges.where((F.col("field") != LEVEL) & (F.col("median") > 0) & (F.col("median") < F.col("screen"))).select("e", "field", "median"), "weak")
    counts = judges.select("e", "field")

    impossible = of(IMPOSSIBLE).select("e", "field", "id")
    jumps = of(JUMP).join(judges, ["e", "field"]).where((F.col("median") > 0) & (F.col("a") >= by_kind(rules.jump) * F.col("median"))).select("e", "field", "id")

    # a change of segment inside a run doesn't end it
    ends = of(RUN).where(F.col("id") != INNER)
    stitched = ends.groupBy("e").applyInPandas(_stitch, ends.schema)
    runs = of(RUN).where(F.col("id") == INNER).unionByName(stitched)
    candidate = (F.col("a") >= CANDIDATE) | ((F.col("field") == RATIO) & (F.col("n") >= rules.stuck_ratio_run))
    ordinary = runs.groupBy("e", "field").agg(F.coalesce(F.max(F.when(~candidate, F.col("n"))), F.lit(1)).alias("usual"))
    held = runs.where(candidate).join(ordinary, ["e", "field"]).join(counts, ["e", "field"])
    factor = F.lit(rules.stuck_factor)
    missed = held.groupBy("e", "field").agg(F.max(F.when(F.col("n") < factor * F.col("usual"), F.col("n"))).alias("missed"))
    longest = F.greatest("usual", F.coalesce("missed", "usual"))
    stuck = F.when(F.col("field") == RATIO, F.col("n") >= rules.stuck_ratio_run).otherwise(F.col("n") >= factor * longest)
    verified = held.join(missed, ["e", "field"]).where(stuck).select("e", "field", "seg", "run")
    members = of(MEMBER).join(verified, ["e", "field", "seg", "run"], "left_semi").select("e", "field", "id")
    return impossible.unionByName(jumps).unionByName(_unscreened(rows, weak, rules)).unionByName(members).distinct()
