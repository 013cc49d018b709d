"""URL filter: host and path rules, and for the rest a ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, stash
from .ngram_lm import hot_and_cold, split_join

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Longest context in bytes; counts are exact tables.
ORDER = 5
#: Weight of the shorter context's estimate, in counts.
PRIOR = 1.5
#: Share of the labelled URLs that sets the threshold (one in so many), and the width of its histogram.
CALIBRATION = 5
BINS, SPAN = 2000, 10.0
START = b"\x02" * ORDER


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_name(host_: str, path_: str) -> str:
    return host_ + path_


def match(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, a path that starts with its path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(rule_name(r[1], r[2]))):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(rule_name(h, p)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _windows(addresses: DataFrame) -> DataFrame:
    """(id, yes, no, h, n): how often a window of ORDER bytes and the next one, in 48 bits, stands in an address (id, address, yes, no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            data = [START + u.encode() + b"\x03" for u in batch.column(3).to_pylist()]
            sizes = np.array([len(d) for d in data], np.int64)
            flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
            owner = np.repeat(np.arange(len(data)), sizes)
            place = np.flatnonzero(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER)
            window = sum(flat[place - k] << (8 * k) for k in range(ORDER + 1))
            pairs, n = np.unique(np.stack([owner[place], window]), axis=1, return_counts=True)
            rows = pa.array(pairs[0])
            columns = [batch.column(i).take(rows) for i in range(3)] + [pa.array(pairs[1]), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "yes", "no", "h", "n"])

    return addresses.select("id", "yes", "no", "address").mapInArrow(run, "id bigint, yes bigint, no bigint, h bigint, n bigint")


def _valued(windows: DataFrame) -> DataFrame:
    """(h, c, value): log p(accepted) - log p(rejected) of every window's last byte, from exact counts of all orders."""
    table = stash(
        windows.groupBy("h").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("yes")).alias("yes"), F.sum(F.col("n") * F.col("no")).alias("no")), "windows"
    )
    out = table.select("h", "c").withColumns({"p_yes": F.lit(1 / 256), "p_no": F.lit(1 / 256)})
    for order in range(ORDER + 1):
        key = F.col("h").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        nexts = stash(table.groupBy(key.alias("_next")).agg(F.sum("yes").alias("_ny"), F.sum("no").alias("_nn")), "nexts")
        before = F.shiftright("_next", 8).alias("_before")
        seen = stash(nexts.groupBy(before).agg(F.sum("_ny").alias("_sy"), F.sum("_nn").alias("_sn")), "seen")
        nexts = nexts.withColumn("_b", before).join(seen, F.col("_b") == F.col("_before")).drop("_b")
        out = out.withColumn("_key", key).join(nexts, F.col("_key") == F.col("_next"))
        mixed = lambda n, s, p: (F.col(n) + PRIOR * F.col(p)) / (F.col(s) + PRIOR)
        out = out.select("h", "c", mixed("_ny", "_sy", "p_yes").alias("p_yes"), mixed("_nn", "_sn", "p_no").alias("p_no"))
    return stash(out.select("h", "c", (F.log("p_yes") - F.log("p_no")).alias("value")), "values")


def with_ratio(urls: DataFrame, learned: Column, accepted: Column) -> DataFrame:
    """Add ``ratio`` to a table with a column ``address``: the mean log ratio of its bytes under the models of the ``learned`` rows."""
    keyed = urls.withColumn("_id", F.xxhash64("address"))
    addresses = keyed.groupBy(F.col("_id").alias("id")).agg(
        F.min("address").alias("address"),
        F.sum((learned & accepted).cast("long")).alias("yes"), F.sum((learned & ~accepted).cast("long")).alias("no"),
    )
    addresses = addresses.withColumns({"yes": F.coalesce("yes", F.lit(0)).cast("long"), "no": F.coalesce("no", F.lit(0)).cast("long")})
    windows = stash(_windows(addresses), "places")
    hot, cold = hot_and_cold(_valued(windows))
    valued = split_join(windows.select("id", "h", "n"), hot.select("h", "value"), cold.select("h", "value"), "h")
    ratios = valued.groupBy("id").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("ratio"))
    return keyed.join(stash(ratios, "ratios"), F.col("_id") == F.col("id")).drop("_id", "id")


def calibrate(scored: DataFrame) -> float:
    """The threshold that tells (ratio, accepted) rows apart best: largest mean of both classes' shares told right."""
    bin_ = F.floor((F.least(F.greatest("ratio", F.lit(-SPAN)), F.lit(SPAN)) + SPAN) / (2 * SPAN) * BINS)
    got = scored.groupBy(bin_.alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    yes, no = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in got:
        yes[r["bin"]], no[r["bin"]] = r["yes"], r["n"] - r["yes"]
    if not yes.sum() or not no.sum():
        return 0.0
    right = (yes[::-1].cumsum()[::-1] / yes.sum() + (no.cumsum() - no) / no.sum()) / 2  # accepted from this bin on
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * SPAN - SPAN)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, ratio; one row per row of ``pages``.

    The longest fitting rule decides. Both models learn from all URLs that a rule decides, but for one in five, which
    set the threshold; where no rule fits, the verdict is ``allow`` if the URL's ratio reaches the threshold. Null
    URLs and such without ``://`` have empty host and path, fit no rule and are judged as an empty address. Without
    URLs of both verdicts the ratio is 0 and everything is allowed that no rule blocks.
    """
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.withColumn("found", match(F.col("host"), F.col("path"), rules))
    urls = urls.select("page_id", "host", "path", "found.rule", "found.verdict", F.concat("host", "path").alias("address"))
    urls = stash(urls, "urls")
    ruled = urls.where("verdict is not null").select("address", (F.col("verdict") == "allow").alias("accepted"))
    apart = F.crc32(F.col("address").cast("binary")) % CALIBRATION == 0
    kinds = ruled.groupBy("accepted").agg(F.count(F.lit(1)).alias("n")).collect()
    if len(kinds) < 2:
        return urls.withColumn("ratio", F.lit(0.0)).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "ratio")
    accepted = F.col("verdict") == "allow"
    scored = stash(with_ratio(urls, F.col("verdict").isNotNull() & ~apart, accepted), "scored")
    threshold = calibrate(scored.where(F.col("verdict").isNotNull() & apart).select("ratio", accepted.alias("accepted")))
    method = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "ratio")
