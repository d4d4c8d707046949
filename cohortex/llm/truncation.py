"""Texts that lost their end: a classifier trained on texts cut on purpose.

Every intact-looking text of a bounded sample is cut, at random places and at
length limits, which gives positives; the text itself is the negative.  A
logistic regression over hashed features of the closing characters, the
punctuation, the markup left open and the distance to the source's length
limit is trained on them and scores every record.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortex.operators.ranking import uniform
from cohortex.staging import stage

WORD_BUCKETS = 1 << 18
SLOTS = 1 << 18
#: Slots kept for the limit features; hashed features never use them.
AT_LIMIT, BELOW_LIMIT = SLOTS, SLOTS + 1
DIM = SLOTS + 2

#: Bytes that a cut at a byte limit may leave out to end between characters.
SLACK = 3

#: Lengths on each side of a spike that say how many rows are usual there.
SIDE = 15

#: Occurrences per million words below which a word is rare; the same at every corpus size.
RARE = 17.0

_SPAN = re.compile(r"(\w+)((?:''+|\]\])*[.!?…;:]*)")
_BUILT = re.compile(r"[.\]}|=]")
_LAST = re.compile(r"(\w+)\W*$")
#: What a broken transfer or an abridging program leaves behind the cut.
_RESIDUE = re.compile(r"(?P<dots>\.{3}|…)$|(?P<mark>\s*[\[(]\s*(?:…|\.{3})?\s*[\])]?)$|(?P<entity>\s*&#?\w{0,8})$")


@dataclass(frozen=True)
class Options:
    """train_rows: the documented bound of the labelled sample; cuts: positives made of each text; least: features seen less often in the sample keep weight 0; threshold: score from which a record counts as cut; prior: log odds added to the balanced model, since cuts are rarer than in its sample; suspect: log odds from which an original is no longer used as intact; spike_rows, spike_sigmas: a length is a spike if it has at least so many rows, and so many deviations, more than are usual around it."""

    train_rows: int = 20_000
    cuts: int = 2
    threshold: float = 0.5
    prior: float = -1.7
    suspect: float = 1.0
    spike_rows: int = 8
    spike_sigmas: float = 6.0
    rounds: int = 250
    least: int = 20
    l2: float = 1e-8
    seed: int = 3


def bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


def word_statistics(docs: DataFrame, text: str) -> np.ndarray:
    """Over all documents, per hash bucket of words: how often it occurs, how often with sentence punctuation behind it, and (first bucket) all words.

    The result has WORD_BUCKETS rows whatever the size of the corpus; tasks
    send sums per bucket.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, WORD_BUCKETS), np.int64)
        for batch in batches:
            c: Counter = Counter()
            for t in batch["t"]:
                c.update(_SPAN.findall(t.lower()))
            for (w, tail), n in c.items():
                b = bucket(w, WORD_BUCKETS)
                total[0, b] += n
                if tail and tail[-1] in ".!?…":
                    total[1, b] += n
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"b": at, "n": total[0, at], "e": total[1, at]})

    rows = docs.select(F.col(text).alias("t")).where("t <> ''").mapInPandas(count, "b long, n long, e long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).toPandas()
    out = np.zeros((3, WORD_BUCKETS), np.int64)
    out[0, rows["b"]], out[1, rows["b"]], out[2, 0] = rows["n"], rows["e"], rows["n"].sum()
    return out


def _line_kind(line: str) -> str:
    if not line:
        return "blank"
    if re.fullmatch(r"=+[^=].*?=+", line):
        return "heading"
    if line.startswith("=="):
        return "heading-open"
    if line == "|}":
        return "table-end"
    if line.startswith(("|", "!", "{|")):
        return "row"
    if line.startswith(("*", "#", ":", ";")):
        return "item"
    if line.endswith("-->"):
        return "comment"
    if re.fullmatch(r"\[\[[^\[\]]*\]\]", line):
        return "link-line"
    if line.endswith("}}"):
        return "template"
    if line.endswith(">"):
        return "tag"
    return "prose"


def ending(t: str) -> str:
    """How a text ends: a closed line's kind, ``ended`` for prose with a full stop, else ``open``."""
    core = t.rstrip()
    kind = _line_kind(core[core.rfind("\n") + 1 :].strip())
    return kind if kind in CLOSED else "ended" if kind == "prose" and re.search(r"[.!?]\W*$", core[-20:]) else "open"


CLOSED = frozenset({"heading", "table-end", "comment", "link-line", "template", "tag"})


def _char_kind(c: str) -> str:
    if c.isalpha():
        return "letter"
    if c.isdigit():
        return "digit"
    if c.isspace():
        return "space"
    return c


def features(t: str, relation: str, stats: np.ndarray) -> list[int]:
    """Hashed slots of one text: the same number for every text.  relation: how a stated length compares to the real one."""
    core = t.rstrip()
    residue = "newline" if t.endswith("\n") else "none"
    m = _RESIDUE.search(core)
    if m:
        residue = m.lastgroup or "none"
        core = core[: m.start()].rstrip()
    nl = core.rfind("\n")
    line = core[nl + 1 :].strip()
    kind = _line_kind(line)
    last = core[-1:] or "^"
    tail = core[-80:]
    w = _LAST.search(tail)
    word = w.group(1).lower() if w else ""
    at_end = bool(w) and core.endswith(w.group(1))
    n, e = (int(x) for x in stats[:2, bucket(word, WORD_BUCKETS)]) if word else (0, 0)
    rate = n / max(1, int(stats[2, 0])) * 1e6
    common = int(n > 2 and rate >= RARE)
    ends = 0 if e == 0 else 1 if e < 0.05 * n else 2 if e < 0.2 * n else 3 if e < 0.5 * n else 4
    state = (f"number{min(len(word), 5)}" if word.isdigit() else f"{common}{ends}") if at_end else "-"
    shape = "".join(_char_kind(c)[0] for c in core[-3:])
    open_line = line.count("[[") > line.count("]]")
    open_ref = t.count("<ref") > t.count("</ref") + t.count("/>")
    open_template = t.count("{{") > t.count("}}")
    open_table = t.count("{|") > t.count("\n|}") + t.startswith("|}")
    open_comment = t.count("<!--") > t.count("-->")
    quotes = line.count("''") % 2
    said = kind == "prose" and bool(re.search(r"[.!?]\W*$", core))
    lonely = len(core) < 120 and not _BUILT.search(core)
    upper = line[:1].isupper() or not line[:1].isalpha()
    got = [
        "bias", f"closed:{kind in CLOSED}:{open_comment}:{open_line}", f"kind:{kind}", f"last:{kind}:{_char_kind(last)}", f"shape:{shape}", f"residue:{residue}", f"residue:{residue}:{kind}:{state}", f"state:{kind}:{state}", f"word:{(word if common else 0) if at_end else '-'}:{residue}",
        f"said:{said}", f"open-line:{open_line}", f"open-ref:{open_ref}", f"open-template:{open_template}:{kind}", f"open-table:{open_table}:{kind}", f"open-comment:{open_comment}", f"quotes:{quotes}",
        f"relation:{relation}", f"lonely:{lonely}:{upper}", f"prose-state:{said}:{lonely}:{state}",
    ]
    return [bucket(g, SLOTS) for g in got]


def _relation(stated: float | None, chars: int, size: int) -> str:
    if stated is None or stated != stated:
        return "null"
    s = int(stated)
    return "equal" if s == chars else "bytes" if s == size else "more" if s > chars else "less"


def _excess(per: DataFrame, opt: Options) -> DataFrame:
    """Spikes of ``source, measure, at, n, open`` (one row a length): the lengths with far more rows than the mean of the SIDE lengths on either side, with that mean (``usual``, ``usual_open``).

    Poisson counts deviate by the root of their mean, so a limit shows by its
    excess however small its share of the source.  One row a length is left
    of the texts here, so the windows are short.
    """
    near = Window.partitionBy("source", "measure").orderBy("at").rangeBetween(-SIDE, SIDE)
    usual = [((F.sum(c).over(near) - F.col(c)) / (2.0 * SIDE)).alias(f"usual_{c}" if c != "n" else "usual") for c in ("n", "open")]
    return per.select("*", *usual).where(F.col("n") - F.col("usual") >= F.greatest(F.lit(float(opt.spike_rows)), opt.spike_sigmas * F.sqrt("usual")))


def length_spikes(docs: DataFrame, text: str, source: str, opt: Options) -> frozenset:
    """Lengths (source, ``chars`` or ``size``, length) at which a source has suspiciously many rows: they train nothing."""
    t, s = F.col(text), F.lower(F.trim(source))
    both = F.array(F.struct(F.lit("chars").alias("measure"), F.length(t).alias("at")), F.struct(F.lit("size").alias("measure"), F.octet_length(t).alias("at")))
    per = docs.where(F.col(text) != "").select(s.alias("source"), F.explode(both).alias("l")).groupBy("source", "l.measure", "l.at").agg(F.count(F.lit(1)).alias("n"))
    hit = _excess(per.withColumn("open", F.lit(0)), opt)
    return frozenset((r["source"], r["measure"], r["at"]) for r in hit.select("source", "measure", "at").collect())


def extract(docs: DataFrame, doc: str, text: str, source: str, stated: str | None, stats: np.ndarray, share: float, opt: Options, spikes: frozenset = frozenset()) -> DataFrame:
    """Feature rows: one per record (``label`` null), and the cut copies (1) and originals (0) of a hashed ``share`` of them.

    ``of`` groups the rows of one record; ``limit_cut`` marks copies that stand
    for cuts at a limit.  Rows of label 2 say how a text ends that is cut
    anywhere, also between sentences or lines, as limits cut.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, s, t, n, u in batch[["d", "s", "t", "n", "u"]].itertuples(index=False):
                chars, size = len(t), len(t.encode())
                f = features(t, _relation(n, chars, size), stats)
                out.append((d, s, chars, size, None, False, ending(t), f))
                if u >= share or chars < 40 or (s, "chars", chars) in spikes or (s, "size", size) in spikes:
                    continue
                out.append((d, s, chars, size, 0, False, "", f))
                if not _finished(t):
                    continue
                rng = random.Random(f"{opt.seed}:{d}")
                out.append((d, s, 0, 0, 2, False, ending(t[: rng.randrange(20, chars - 1)]), f))
                for k in range(opt.cuts):
                    cut = t[: rng.randrange(20, chars - 1)]
                    if not _unfinished(t, len(cut)):
                        cut = t[: rng.randrange(20, chars - 1)]
                    if not _unfinished(t, len(cut)):
                        continue
                    rel = "null" if rng.random() < 0.02 else "more" if rng.random() < 0.5 else "equal"
                    r = rng.random()
                    cut += "..." if r < 0.04 else " […]" if r < 0.1 else " (" if r < 0.14 else " &nb" if r < 0.18 else "\n" if r < 0.24 else ""
                    out.append((d, s, len(cut), len(cut.encode()), 1, k == 1, "", features(cut, rel, stats)))
            yield pd.DataFrame(out, columns=["of", "source", "chars", "size", "label", "limit_cut", "ending", "f"]).astype({"label": "Int64"})

    n = F.col(stated).cast("double") if stated else F.lit(None).cast("double")
    slim = docs.select(F.col(doc).cast("long").alias("d"), F.lower(F.trim(source)).alias("s"), F.col(text).alias("t"), n.alias("n")).where("d is not null and t <> ''")
    return slim.withColumn("u", uniform("d", seed=opt.seed)).mapInPandas(rows, "of long, source string, chars int, size int, label long, limit_cut boolean, ending string, f array<int>")


def _finished(t: str) -> bool:
    """Has some sentence or markup and ends like a whole text: only such texts are cut for positives."""
    core = t.rstrip()
    return bool(_BUILT.search(core)) and core[-1:] in ".!?]}>|=" or core[core.rfind("\n") + 1 :].startswith("*")


def _unfinished(t: str, at: int) -> bool:
    """Would a reader see that a cut here lost something: not between sentences, lines or after closed markup."""
    before = t[:at].rstrip()
    return at < len(t.rstrip()) and before[-1:] not in ".!?]}>|=" and t[at : at + 1] != "\n"


def train(f: np.ndarray, extra: np.ndarray, y: np.ndarray, opt: Options) -> np.ndarray:
    """Weights of a logistic regression by gradient steps with per-weight rates; f: slots (n, k), extra: one slot of the limit features a row, or -1."""
    used, at = np.unique(np.concatenate((f.ravel(), extra[extra >= 0])), return_inverse=True)  # weights of other slots stay 0
    n, k = f.shape
    slot, has = at[: n * k].reshape(n, k), extra >= 0
    limit = np.zeros(n, np.int64)
    limit[has] = at[n * k :]
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    often = np.bincount(at, minlength=len(used)) >= opt.least
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(opt.rounds):
        z = w[slot].sum(1) + np.where(has, w[limit], 0.0)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(slot.ravel(), weights=np.repeat(err, k), minlength=len(used)) + np.bincount(limit[has], weights=err[has], minlength=len(used)) + opt.l2 * w
        g2 += g * g
        w -= often * 0.5 * g / np.sqrt(g2)
    out = np.zeros(DIM)
    out[used] = w
    return out


def _score(df: DataFrame, w: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = w[np.array(batch["f"].tolist(), np.int64).reshape(len(batch), -1)].sum(1)
            yield batch[["of", "source", "chars", "size", "ending"]].assign(z=z)

    return df.mapInPandas(run, "of long, source string, chars int, size int, ending string, z double")


def _lookup(spark: SparkSession, limits: list[tuple[str, str, int, int, float, float]], measure: str) -> DataFrame:
    """The lengths of one measure that are at a limit, each once: for bytes also the SLACK below; the nearest limit above counts."""
    at: dict[tuple, tuple] = {}
    for no, (s, m, limit, _, odds, usual) in enumerate(limits):
        slack = SLACK if m == "size" else 0
        for k in range(slack + 1 if m == measure else 0):
            if (s, limit - k) not in at or limit < at[s, limit - k][0]:
                at[s, limit - k] = (limit, no, odds, usual * (slack + 1))
    names = ["source string", "len int", "at long", "no int", "odds double", "usual double"]
    t = spark.createDataFrame([(*k, *v) for k, v in at.items()], ", ".join(f"{measure}_{n}" for n in names))
    return F.broadcast(t) if len(at) <= 50_000 else t


def _same_length(measure: str) -> Column:
    return F.col("source").eqNullSafe(F.col(f"{measure}_source")) & (F.col(measure) == F.col(f"{measure}_len"))


def length_limits(scored: DataFrame, opt: Options) -> list[tuple[str, str, int, int, float, float]]:
    """All length limits seen in the data: (source, ``chars`` or ``size``, limit, rows there, log odds of being cut there, usual rows there).

    A limit is a length with far more rows than the lengths around it
    (``_excess``), where most of the rows too many have endings that look cut.
    The odds compare the rows there with the usual number (one row at least).
    Texts cut at a number of characters also make spikes of bytes, and the
    other way round: so each round takes the spike with most rows of every
    source and leaves its rows out of the next, until no spike is left.  Only
    spikes reach the driver; there is one round for each limit of the source
    that has most.
    """
    spark = scored.sparkSession
    per = stage(scored.groupBy("source", "chars", "size").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("z") > 0).cast("long")).alias("open")), "lengths")
    both = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("at")) for m in ("chars", "size")])
    limits: list[tuple] = []
    while True:
        rest = per
        for m in sorted({x[1] for x in limits}):
            rest = rest.join(_lookup(spark, limits, m), _same_length(m), "left_anti")
        one = rest.select("source", "n", "open", F.explode(both).alias("l")).groupBy("source", "l.measure", "l.at").agg(F.sum("n").alias("n"), F.sum("open").alias("open"))
        spikes: dict[str | None, dict] = {}
        for r in _excess(one, opt).where(F.col("open") - F.col("usual_open") >= 0.5 * (F.col("n") - F.col("usual"))).collect():
            spikes.setdefault(r["source"], {})[r["measure"], r["at"]] = (r["n"], r["usual"])
        if not spikes:
            return limits
        for s, found in spikes.items():
            measure, at = min(found, key=lambda k: (-found[k][0], k))
            if measure == "size":  # cuts that end between characters stay below the limit
                at = max(k for m, k in found if m == "size" and at <= k <= at + SLACK)
            n, usual = found[measure, at]
            limits.append((s, measure, at, n, float(np.log(max(1.0, n / max(1.0, usual)))), usual))


def _at_limits(scored: DataFrame, limits: list[tuple[str, str, int, int, float, float]]) -> DataFrame:
    """``scored`` with the limit each row sits at (``no, at, odds, usual``; of two, that with the better odds; null: at none) and ``main``, its source's limit with most rows."""
    spark = scored.sparkSession
    main: dict[str | None, tuple] = {}
    for s, _, at, n, _, _ in limits:
        if s not in main or n > main[s][0]:
            main[s] = (n, at)
    t = spark.createDataFrame([(s, at) for s, (_, at) in main.items()], "l_source string, main long")  # one row a source at most
    out = scored.join(F.broadcast(t) if len(main) <= 50_000 else t, F.col("source").eqNullSafe(F.col("l_source")), "left")
    for m in ("chars", "size"):
        out = out.join(_lookup(spark, limits, m), _same_length(m), "left")
    chars = F.col("chars_no").isNotNull() & (F.col("size_no").isNull() | (F.col("chars_odds") >= F.col("size_odds")))
    return out.select(*scored.columns, "main", *[F.when(chars, F.col(f"chars_{c}")).otherwise(F.col(f"size_{c}")).alias(c) for c in ("no", "at", "odds", "usual")])


def cut_records(docs: DataFrame, doc: str, text: str, source: str, stated: str | None = None, opt: Options = Options()) -> DataFrame:
    """``doc_id, source, score, cut, limit``: every record with text, its probability of having lost its end, and the length limit it sits at, or else the one of its source with most rows (null: none seen).

    stated: a column with the length somebody once measured; wrong values are
    expected.  Null and empty texts are no cases and do not come out.  Sources
    are compared trimmed and in lower case, a null source is one of its own.
    Whole texts are read by Python twice, for the word statistics and for the
    features (and once by the JVM for their lengths); everything later reads
    the staged features.

    A text that ends in a closed line or a full sentence exactly at its
    source's limit may have been cut there by chance, or be whole.  The share
    of such endings among texts cut anywhere says how many of the rows at the
    limit chance explains; that share of them is their score.
    """
    stats = word_statistics(docs, text)
    rows = docs.select(F.col(text).alias("t")).where("t <> ''").count()
    f = stage(extract(docs, doc, text, source, stated, stats, min(1.0, opt.train_rows / max(1, rows)), opt, length_spikes(docs, text, source, opt)), "features")
    sample = f.where("label in (0, 1)").drop("source").toPandas()
    chance = {r["ending"]: r["count"] for r in f.where("label = 2").groupBy("ending").count().collect()}
    spark = docs.sparkSession
    empty = "doc_id long, source string, score double, cut boolean, limit long"
    real = f.where("label is null")
    if not len(sample) or sample["label"].nunique() < 2:
        return real.select(F.col("of").alias("doc_id"), "source", F.lit(0.0).alias("score"), F.lit(False).alias("cut"), F.lit(None).cast("long").alias("limit")) if rows else spark.createDataFrame([], empty)
    slots, y = np.array(sample["f"].tolist(), np.int64), sample["label"].to_numpy(np.int64)
    none = np.full(len(y), -1, np.int64)
    use = np.ones(len(y), bool)
    half = (sample["of"] % 2 == 0).to_numpy()
    for _ in range(3):  # originals that look cut to a model that has not seen them leave the negatives, with their copies
        z = np.empty(len(y))
        for side in (half, ~half):
            z[side] = train(slots[use & ~side], none[use & ~side], y[use & ~side], opt)[slots[side]].sum(1)
        bad = set(sample["of"][(y == 0) & (z > opt.suspect)])
        use = ~sample["of"].isin(bad).to_numpy()
    w = train(slots[use], none[use], y[use], opt)
    scored = stage(_score(real, w), "tails")
    limits = length_limits(scored, opt)
    extra = np.where((y == 1) & sample["limit_cut"].to_numpy(bool), AT_LIMIT, BELOW_LIMIT)
    w2 = train(slots[use], extra[use], y[use], opt) if limits else w
    j = stage(_at_limits(_score(real, w2), limits).withColumn("at_limit", F.col("no").isNotNull()), "scored")
    step = F.when(F.col("at_limit"), F.col("odds") + opt.prior + float(w2[AT_LIMIT])).otherwise(F.lit(opt.prior + float(w2[BELOW_LIMIT] if limits else 0.0)))
    seen = j.where("at_limit").groupBy(F.col("no").alias("m_no"), F.col("ending").alias("m_ending")).agg(F.count(F.lit(1)).alias("seen"))
    rows_at = j.where("at_limit").groupBy(F.col("no").alias("a_no")).agg(F.greatest(F.lit(0.0), F.count(F.lit(1)) - F.max("usual")).alias("rows_at"))
    mix = seen.join(rows_at, F.col("m_no") == F.col("a_no")).where("m_ending <> 'open'")
    share = F.coalesce(*[F.when(F.col("m_ending") == e, F.lit((n + 0.5) / (sum(chance.values()) + 5.0))) for e, n in chance.items()], F.lit(0.5 / (sum(chance.values()) + 5.0)))
    mix = mix.select("m_no", "m_ending", F.least(F.lit(0.99), share * F.col("rows_at") / F.col("seen")).alias("p"))
    m = F.broadcast(mix) if len(limits) <= 50_000 else mix  # at most one row per limit and kind of ending
    j = j.join(m, (F.col("no") == F.col("m_no")) & (F.col("ending") == F.col("m_ending")), "left")
    score = F.coalesce(F.col("p"), 1 / (1 + F.exp(-(F.col("z") + step))))
    return j.select(F.col("of").alias("doc_id"), "source", score.alias("score"), (score >= opt.threshold).alias("cut"), F.coalesce("at", "main").alias("limit"))


def source_rates(records: DataFrame) -> DataFrame:
    """``source, records, cut, rate, limit, limits`` of the records that ``cut_records`` scored; limit: the largest, limits: all of them."""
    limits = F.sort_array(F.collect_set("limit")).alias("limits")
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("cut").cast("long")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("rate"), F.max("limit").alias("limit"), limits)
