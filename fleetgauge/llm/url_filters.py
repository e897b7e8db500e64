"""URL filters: listed rules first, then a tree of path templates per host.

Paths are collapsed to typed segments (numbers, hexadecimal ids, mixed tokens), so the tree is
built from counts, not from pages. A node steps over what all its paths have in common and branches at
the first segment that differs. Frequent branches whose labelled block rate does not differ
significantly from the node's are merged, the other frequent ones keep their name, and very many rare ones
become one wildcard. This goes on as deep as the paths do, until a template's labels all agree or it
has one path only. A template is rejected if its block rate, smoothed towards its parent's and so on up to
the host, is high enough. Labels are the verdicts of the rules, or a column of the caller. DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import write_once

#: (verdict, host, path): a rule fits its host and all subdomains from this path on; longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Branches of fewer than `RARE` pages become one wildcard if a node has more than `CHILDREN` of them.
CHILDREN, RARE = 20, 5
#: Deviations from the parent's rate up to which a branch is merged.
SIMILAR = 2.0
#: Weight of the parent's rate in labelled pages, rate of a host without labels, and rate that rejects.
SMOOTHING, PRIOR, REJECT = 10.0, 0.1, 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Host after the first `://`, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule text and verdict of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def typed_segments(path: Column) -> Column:
    """Segments with variable parts replaced by their type; `$` marks a path's end."""

    def typed(s: Column) -> Column:
        return (F.when(s.rlike(r"^[0-9]+(\.[a-z]{2,5})?$"), F.regexp_replace(s, "^[0-9]+", "{n}"))
                .when(s.rlike(r"^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), F.lit("{hex}"))
                .when(s.rlike(r"[0-9]"), F.regexp_replace(s, "[0-9]+", "{n}")).otherwise(s))

    return F.concat(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), typed), F.array(F.lit("$")))


def _common(a: Column, b: Column) -> Column:
    """Number of leading segments that two arrays have in common."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def templates(counts: DataFrame) -> DataFrame:
    """Template and smoothed block rate of every (host, segments), from counts n, bad and good.

    A template that ends in `/~` stands for whatever follows. The loop takes one round per branching on the
    way to labels that disagree, not per segment; each round reads the paths that are still open only.
    """
    total = lambda c: F.sum(c).alias(f"_{c}")
    rate = (F.col("_bad") + SMOOTHING * F.col("_p")) / (F.col("_bad") + F.col("_good") + SMOOTHING)
    mixed = (F.col("_bad") > 0) & (F.col("_good") > 0)

    hosts = counts.groupBy(F.col("host").alias("_h")).agg(total("bad"), total("good")).withColumn("_p", F.lit(PRIOR))
    tree = counts.join(hosts.select("_h", rate.alias("p"), mixed.alias("open")), F.col("host") == F.col("_h")).select(
        "host", "segments", F.col("segments").alias("rest"), "n", "bad", "good", F.lit("").alias("template"), "p", "open")
    done = []
    while True:
        tree = write_once(tree, "url-tree")
        ends = F.when((F.size("rest") > 0) & (F.col("rest") != F.array(F.lit("$"))), F.concat("template", F.lit("/~"))).otherwise(F.col("template"))
        done.append(tree.filter("not open").select(F.col("host").alias("_th"), F.col("segments").alias("_ts"), ends.alias("template"), F.col("p").alias("block_rate")))
        live = tree.filter("open")
        if live.isEmpty():
            break
        # the first and last path of a node in order have in common what all of them have
        node = live.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(total("bad"), total("good"), F.min("rest").alias("_from"), F.max("rest").alias("_to"))
        node = node.withColumn("_skip", _common(F.col("_from"), F.col("_to")))
        here = live.join(node, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
        shared = F.filter(F.slice("rest", F.lit(1), F.col("_skip")), lambda x: x != "$")
        here = write_once(here.select("host", "segments", F.slice("rest", F.col("_skip") + 2, F.size("rest")).alias("rest"), "n", "bad", "good", "template", "p",
                                      F.coalesce(F.get("rest", F.col("_skip")), F.lit("")).alias("seg"),
                                      F.concat("template", F.array_join(F.transform(shared, lambda x: F.concat(F.lit("/"), x)), "")).alias("way"),
                                      F.col("_bad").alias("node_bad"), F.col("_good").alias("node_good")), "url-branches")
        branch = here.groupBy("host", "template", "seg").agg(F.first("p").alias("_p"), F.first("way").alias("way"), F.first("node_bad").alias("_b"), F.first("node_good").alias("_g"),
                                                             F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        few = branch.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(F.count_if(F.col("n") < RARE).alias("_few"))
        both = branch.join(few, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
        labelled, mean = F.col("bad") + F.col("good"), F.col("_b") / F.greatest(F.col("_b") + F.col("_g"), F.lit(1))
        alike = F.abs(F.col("bad") - labelled * mean) <= SIMILAR * F.sqrt(labelled * mean * (1 - mean))
        rare = (F.col("_few") > CHILDREN) & (F.col("n") < RARE)
        name = (F.when(F.col("seg").isin("", "$"), F.col("way")).when(rare, F.concat("way", F.lit("/*"))).when(alike, F.concat("way", F.lit("/~"))).otherwise(F.concat("way", F.lit("/"), "seg")))
        named = both.withColumn("_name", name).select("host", "template", "seg", "_name", "_p", "_b", "_g", "bad", "good")
        child = named.groupBy(F.col("host").alias("_h"), F.col("_name").alias("_c")).agg(*[F.first(c).alias(c) for c in ("_p", "_b", "_g")], total("bad"), total("good"))
        # a branch with all labels of its node has the node's rate: the same labels count once
        again = (F.col("_bad") == F.col("_b")) & (F.col("_good") == F.col("_g"))
        child = child.select("_h", "_c", F.when(again, F.col("_p")).otherwise(rate).alias("_rate"), mixed.alias("_open"))
        to = named.join(child, (F.col("host") == F.col("_h")) & (F.col("_name") == F.col("_c"))).select(
            F.col("host").alias("_nh"), F.col("template").alias("_nt"), F.col("seg").alias("_ns"), "_name", "_rate", "_open")
        tree = here.join(to, (F.col("host") == F.col("_nh")) & (F.col("template") == F.col("_nt")) & (F.col("seg") == F.col("_ns"))).select(
            "host", "segments", "rest", "n", "bad", "good", F.col("_name").alias("template"), F.col("_rate").alias("p"), (F.col("_open") & (F.size("rest") > 0)).alias("open"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               label: Column | None = None, reject: float = REJECT) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict, template and block_rate.

    The rule's verdict holds; without one the template decides. `label` is an optional column of
    `pages`, 1 for pages to block and 0 for good ones; by default the rules' own verdicts. A
    null url, or one without `://`, has an empty host and path, which are a template like any
    other. Repeated rows are pages each; null ids are kept; an empty table gives no rows; other
    columns are not read.
    """
    link = F.col(url).cast("string")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"), (label if label is not None else F.lit(None)).cast("int").alias("given"))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", typed_segments(F.col("path")))
    bad = F.col("given") == 1 if label is not None else F.col("rule.verdict") == "block"
    good = F.col("given") == 0 if label is not None else F.col("rule.verdict") == "allow"
    rows = write_once(rows, "urls")
    counts = rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(good).alias("good"))
    found = write_once(templates(write_once(counts, "url-counts")), "url-templates")
    joined = rows.join(found, (rows["host"] == found["_th"]) & (rows["segments"] == found["_ts"]))
    own = F.when(F.col("block_rate") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce(F.col("rule.verdict"), own).alias("verdict"), "template", "block_rate")
