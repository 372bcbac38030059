"""URL filter by the ratio of two character language models, behind explicit rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.session import Workspace

from .tables import fold, lower_ascii
from .textblocks import Block, blocks

#: Longest context in bytes, (context, byte) counts that a model holds in memory at most, weight of the next shorter context.
ORDER, ENTRIES, PRIOR = 5, 1 << 20, 3.0
#: Urls that are scored together where some counts stay in a table.
TOGETHER = 10_000
#: What stands before the first byte of a url.
START = 256
#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: One labelled url in so many, by a hash of its id, calibrates and is not learnt from; bins of the calibration.
HELD, BINS, REACH = 5, 2000, 5.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    text = verdict = F.lit(None).cast("string")
    for judged, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(judged)).otherwise(verdict)
    return text, verdict


@dataclass
class Model:
    """Counts of both classes (rejected, accepted) by context and by context with the next byte, both in the order of their
    exact keys, and the calibrated threshold. It holds ENTRIES counts at most: those of the most frequent contexts, each with
    all bytes that follow it, so that a context's next-byte probabilities add up to 1. The counts of all other contexts are in
    the table ``rest`` (context, key, rejected, accepted), None if there are none; ``ratios`` looks them up."""

    followers: np.ndarray
    counts: np.ndarray
    threshold: float = 0.0
    rest: DataFrame | None = None

    def held(self) -> Model:
        """What is sent to tasks."""
        return Model(self.followers, self.counts, self.threshold)

    def __post_init__(self):
        self.contexts, first = np.unique(self.followers >> 8, return_index=True)
        self.totals = np.add.reduceat(self.counts, first, axis=1) if len(first) else np.zeros((2, 0))

    @staticmethod
    def _look(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros((2, len(keys)))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[:, at], 0.0)

    def logs(self, block: Block, more: Model | None = None) -> np.ndarray:
        """Log-probability of every byte under both classes: each order mixes in the next shorter one; a context that was
        not seen leaves all to it. ``more`` holds what the block needs of the other counts."""
        p = np.full((2, int(block.lengths.sum())), 1 / 256)
        for keys in _keys(block):
            seen = self._look(keys >> 8, self.contexts, self.totals)
            count = self._look(keys, self.followers, self.counts)
            if more is not None:
                seen = seen + self._look(keys >> 8, more.contexts, more.totals)
                count = count + self._look(keys, more.followers, more.counts)
            p = (count + PRIOR * p) / (seen + PRIOR)
        return np.log(p)

    def missing(self, block: Block) -> np.ndarray:
        """Distinct contexts of the block that the model does not hold."""
        contexts = np.unique(np.concatenate([keys >> 8 for keys in _keys(block)]))
        return np.setdiff1d(contexts, self.contexts, assume_unique=True)

    def difference(self, block: Block, more: Model | None = None) -> np.ndarray:
        """Mean log-likelihood per byte under accepted less under rejected urls; 0 for an empty url."""
        rejected, accepted = self.logs(block, more)
        rows = np.repeat(np.arange(len(block)), block.lengths)
        return np.bincount(rows, weights=accepted - rejected, minlength=len(block)) / np.maximum(block.lengths, 1)


def _keys(block: Block):
    """For each order from 0 one exact whole number for every byte with its context: the order, the bytes before it, nine
    bits each, with START where the url has none, and the byte."""
    at = np.arange(len(block.raw))
    begin = np.repeat(block.offsets[:-1], block.lengths + 1)
    inside = np.ones(len(at), bool)
    inside[block.offsets[1:] - 1] = False
    at, begin = at[inside], begin[inside]
    raw = block.raw.astype(np.int64)
    context = np.zeros(len(at), np.int64)
    for order in range(ORDER + 1):
        if order:
            place = at - order
            symbol = np.where(place >= begin, raw[np.maximum(place, 0)], START)
            context = context | symbol << np.int64(9 * (order - 1))
        yield (np.int64(order) << np.int64(9 * ORDER) | context) << np.int64(8) | raw[at]


def _least_total(each: DataFrame) -> int:
    """Total from which the contexts' counts, with all their followers, fit into ENTRIES; from a histogram of fixed size."""
    total = F.col("total")
    bins = F.when(total < 1024, total).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("total"))).cast("long"))
    left = ENTRIES
    least = 1 << 62
    for row in each.groupBy(bins.alias("bin")).agg(F.sum("entries").alias("n")).orderBy(F.desc("bin")).collect():
        left -= row.n
        if left < 0:
            break
        least = row.bin
    return least


def ratios(rows: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """The kept columns of rows, and ratio: ``Model.difference`` of their column url, with all counts.

    Where counts stay in a table, urls are dealt into groups of some TOGETHER; a group asks once for each context that the
    model does not hold, and gets that context's counts.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(model.held())
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in kept) + ", ratio double"

    def scored(block, more=None):
        return pa.RecordBatch.from_arrays([*(block.rows.column(c) for c in kept), pa.array(held.value.difference(block, more))],
                                          names=[*kept, "ratio"])

    def run(batches):
        for block in blocks(batches, "url"):
            yield scored(block)

    if model.rest is None:
        return rows.select(*kept, "url").mapInArrow(run, schema)

    room = Workspace(spark, "url-groups")
    groups = 1 + rows.count() // TOGETHER
    dealt = rows.select(*kept, "url", F.pmod(F.xxhash64(*kept, "url"), F.lit(groups)).alias("bundle"))
    dealt = room.save(dealt.repartition("bundle"), "urls")

    def ask(batches):
        for block in blocks(batches, "url"):
            bundles = block.column("bundle")
            for bundle in np.unique(bundles):
                mine = np.flatnonzero(bundles == bundle)
                wanted = held.value.missing(Block(block.rows, [block.texts[i] for i in mine]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wanted), bundle)), pa.array(wanted)], names=["bundle", "context"])

    asked = dealt.mapInArrow(ask, "bundle long, context long").distinct()
    answers = asked.join(model.rest, "context").select("bundle", "key", "rejected", "accepted")

    def answer(urls: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("key")
        more = Model(found["key"].to_numpy(), np.array([found[c].to_numpy() for c in ("rejected", "accepted")], float)) if len(found) else None
        out = [scored(block, more) for block in blocks(urls.combine_chunks().to_batches(), "url")]
        return pa.Table.from_batches(out) if out else pa.table({c: urls[c] for c in kept}).append_column("ratio", pa.array([], pa.float64()))

    return dealt.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(answer, schema)


def train(urls: DataFrame) -> Model:
    """Model from (page_id, url, accepted); accepted is true or false, a null teaches nothing.

    All labelled urls count, repeated ones as often as they occur. Tasks count keys exactly, Spark adds them up in a table, and
    the driver gets ENTRIES counts at most; the others stay in a table that scoring joins. The threshold gives the best mean of both classes' accuracies on the urls kept
    apart, the nearest to 0 of equals. Without urls of both classes it is 0.
    """
    spark = urls.sparkSession
    room = Workspace(spark, "urls")
    known = urls.where(F.col("accepted").isNotNull() & F.col("url").isNotNull()).select(
        F.col("url").cast("string").alias("text"), F.col("accepted").cast("int").alias("label"),
        F.coalesce(fold(F.col("page_id"), HELD) == 0, F.lit(False)).alias("held"), F.col("page_id").alias("place"))

    def count(batches):
        for block in blocks(batches):
            label = np.repeat(block.column("label").astype(np.int64), block.lengths)
            for keys in _keys(block):
                distinct, which = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct), *(pa.array(np.bincount(which[label == y], minlength=len(distinct))) for y in (0, 1))],
                    names=["key", "rejected", "accepted"])

    counts = room.save(known.where(~F.col("held")).mapInArrow(count, "key long, rejected long, accepted long")
                       .groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")), "counts")
    each = counts.groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.sum(F.col("rejected") + F.col("accepted")).alias("total"), F.count(F.lit(1)).alias("entries"))
    each = room.save(each, "contexts")
    least = _least_total(each)
    often = each.where(F.col("total") >= least).select("context")
    table = counts.join(often, F.shiftright("key", 8) == F.col("context"), "left_semi").toPandas().sort_values("key")
    model = Model(table["key"].to_numpy(np.int64), table[["rejected", "accepted"]].to_numpy(float).T.copy())
    seldom = each.where(F.col("total") < least).select("context")
    if not seldom.isEmpty():
        model.rest = room.save(counts.withColumn("context", F.shiftright("key", 8)).join(seldom, "context", "left_semi"), "rest")
    room.keep(*([model.rest] if model.rest is not None else []))
    apart = ratios(known.where("held").select(F.col("text").alias("url"), "label", "place"), model, ["label", "place"])
    at = F.floor((F.col("ratio") + REACH) / (2 * REACH) * BINS)
    apart = apart.groupBy("label", F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin")).count().toPandas()
    sums = np.zeros((2, BINS))
    sums[apart["label"], apart["bin"]] = apart["count"]
    if (sums.sum(1) > 0).all():
        below = np.concatenate([np.zeros((2, 1)), np.cumsum(sums, 1)], 1) / sums.sum(1, keepdims=True)
        gain, edges = below[0] - below[1], np.linspace(-REACH, REACH, BINS + 1)
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float(edges[best[np.argmin(np.abs(edges[best]))]])
    return model


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio for every page.

    The longest rule that fits a url decides; urls that rules decide also teach the two models, which decide all others:
    allow if the length-normalised log-likelihood difference reaches the calibrated threshold. A null, empty or odd url
    (no ``://``) has empty host and path, no rule, and is judged as its bytes are; a null as the empty url, with ratio 0.
    Repeated rows are judged alike. Other columns are not read.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    model = train(rows.select("page_id", "url", (F.col("ruled") == "allow").alias("accepted")))
    judged = ratios(rows, model, ["page_id", "host", "path", "rule", "ruled"])
    fits = F.when(F.col("ratio") >= model.threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", fits).alias("verdict"), "ratio")
