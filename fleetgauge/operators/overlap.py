"""Duplicate and overlapping key lists.

`duplicate_families` labels every object with numbers from which all pairs follow: its place in
the tree of key lists (`prefixes`) and the first object of its set of equals. The table has one row
per object. `family_pairs` reads the pairs from it, at the cost of the pairs there are.
`duplicate_pairs` is a short report: each object beside the first member of its own set and of
each set whose list is a prefix of its own; it does not name every pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.labels import band
from fleetgauge.functions.numbers import row_count
from fleetgauge.operators.prefixes import inside, prefix_tree
from fleetgauge.operators.skew import salted_join


def signature(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str], column: str,
              descending: Column | None = None, included: Column | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """Key columns in ordinal order (with direction) and included columns, as arrays.

    `keep` are attributes of the object, such as its filter. The arrays are as long as the
    object's column list, a catalogue limit.
    """
    order = [F.col(o) for o in ordinal]
    name = F.col(column)
    if descending is not None:
        name = F.concat(name, F.when(descending, ":DESC").otherwise(":ASC"))
    inc = F.lit(False) if included is None else included
    element = lambda text: F.struct(*order, text.alias("_text"))
    agg = df.groupBy(*keys, *keep).agg(
        F.array_sort(F.collect_list(F.when(~inc, element(name)))).alias("k"),
        F.array_sort(F.collect_list(F.when(inc, element(F.col(column))))).alias("i"))
    return agg.select(*keys, *keep, F.col("k._text").alias("key_columns"), F.col("i._text").alias("include_columns"))


def duplicate_pairs(sig: DataFrame, group: Sequence[str], key: str, filter_text: str | None = None) -> DataFrame:
    """Index pairs with equal lists (same keys, includes and filter) or a key-list prefix.

    Same keys with other includes or another filter are not reported.
    """
    group = list(group)
    flt = F.coalesce(F.col(filter_text), F.lit("")) if filter_text else F.lit("")
    members = (sig.filter(F.size("key_columns") > 0)
               .select(*group, F.col(key).alias("_id"), F.col("key_columns").alias("_keys"),
                       F.col("include_columns").alias("_inc"), flt.alias("_flt")))
    same = [*group, "_keys", "_inc", "_flt"]
    counted = members.groupBy(*same).agg(F.min("_id").alias("_first"), row_count().alias("set_size"))
    exact = (salted_join(members, counted.filter(F.col("set_size") > 1), same, "inner",
                         counted=counted.select(*same, F.col("set_size").alias("_rows")))
             .filter(F.col("_id") > F.col("_first"))
             .select(*group, F.col("_first").alias("index_1"), F.col("_id").alias("index_2"),
                     F.lit("EXACT_DUPLICATE").alias("duplicate_type"), "set_size"))

    sets = counted.groupBy(*group, "_keys").agg(F.min("_first").alias("_first"), F.sum("set_size").alias("set_size"))
    lengths = F.sequence(F.lit(1), F.size("_keys") - 1)
    longer = (members.filter(F.size("_keys") > 1).select(*group, "_id", "_keys")
              .withColumn("_len", F.explode(lengths))
              .select(*group, "_id", F.slice("_keys", F.lit(1), F.col("_len")).alias("_keys")))
    low, high = F.least("_first", "_id"), F.greatest("_first", "_id")
    prefix = (salted_join(longer, sets, [*group, "_keys"], "inner")
              .select(*group, low.alias("index_1"), high.alias("index_2"),
                      F.when(F.col("_first") < F.col("_id"), "INDEX1_IS_PREFIX").otherwise("INDEX2_IS_PREFIX").alias("duplicate_type"),
                      "set_size"))
    return exact.unionByName(prefix)


def duplicate_families(sig: DataFrame, group: Sequence[str], key: str, filter_text: str | None = None) -> DataFrame:
    """One row per index with a key list: `entry` and `exit` of its list, the first index of its set of
    equals (same keys, includes and filter) with the size of the set, and `longer_lists`, the number of
    different lists that go on from its own.

    Two indexes of a group are EXACT_DUPLICATE if they have the same `first_equal`; a is a prefix of
    b if a.entry < b.entry < a.exit. Same entry and another first_equal: the same keys with other includes or
    another filter, which is no duplicate.
    """
    group = list(group)
    flt = F.coalesce(F.col(filter_text), F.lit("")) if filter_text else F.lit("")
    members = (sig.filter(F.size("key_columns") > 0)
               .select(*group, F.col(key).alias("_id"), F.col("key_columns").alias("_keys"), F.col("include_columns").alias("_inc"), flt.alias("_flt")))
    same = [*group, "_keys", "_inc", "_flt"]
    equal = members.groupBy(*same).agg(F.min("_id").alias("first_equal"), row_count().alias("set_size"))
    tree = prefix_tree(members, group, "_keys")
    # one row per set and its list's node, then one lookup per index
    sets = equal.join(tree, [equal[c].eqNullSafe(tree[c]) for c in [*group, "_keys"]]).select(*[equal[c] for c in same], "first_equal", "set_size", "entry", "exit", "longer")
    rows = salted_join(members, sets, same, "inner", null_safe=True, counted=equal.select(*same, F.col("set_size").alias("_rows")))
    return rows.select(*group, F.col("_id").alias(key), "entry", "exit", "first_equal", "set_size", F.col("longer").alias("longer_lists"))


def family_pairs(families: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """All pairs that `duplicate_families` says, the smaller index first, with their kind."""
    group = list(group)
    has = families.select(*group, F.col(key).alias("_a"), F.col("entry").alias("_low"), F.col("exit").alias("_high"), F.col("first_equal").alias("_fa"), "longer_lists", "set_size")
    # below a list; the group is in the numbers
    under = inside(families.select(F.col(key).alias("_b"), "entry"), has.filter("longer_lists > 0").withColumn("_low", F.col("_low") + 1), "entry", "_low", "_high")
    prefix = under.select(*group, F.least("_a", "_b").alias("index_1"), F.greatest("_a", "_b").alias("index_2"),
                          F.when(F.col("_a") < F.col("_b"), "INDEX1_IS_PREFIX").otherwise("INDEX2_IS_PREFIX").alias("duplicate_type"))
    equal = has.filter("set_size > 1")
    other = equal.select(F.col("_a").alias("_b"), F.col("_fa").alias("_fb"), F.col("_low").alias("_lb"))
    exact = equal.join(other, (F.col("_low") == F.col("_lb")) & (F.col("_fa") == F.col("_fb")) & (F.col("_a") < F.col("_b")))
    return exact.select(*group, F.col("_a").alias("index_1"), F.col("_b").alias("index_2"), F.lit("EXACT_DUPLICATE").alias("duplicate_type")).unionByName(prefix)


def overlapping_stats(sig: DataFrame, group: Sequence[str], key: str, filter_text: str | None = None) -> DataFrame:
    """Later statistics whose list text starts with an earlier one's.

    The test has no separator, so `a` also matches `ab`. Each statistic is linked to the first member of
    every set (same list and filter) whose list its own starts with; the lists are met by their places
    in the sorted order, not by trying lengths.
    """
    group = list(group)
    flt = F.coalesce(F.col(filter_text), F.lit("")) if filter_text else F.lit("")
    members = sig.select(*group, F.col(key).alias("_id"), F.array_join("key_columns", ",").alias("_list"), flt.alias("_flt"))
    tree = prefix_tree(members, group, "_list")
    on = [members[c].eqNullSafe(tree[c]) for c in [*group, "_list"]]
    placed = members.join(tree, on).select(F.col("_id"), members["_flt"], "entry", "exit", members["_list"], *[members[c] for c in group])
    sets = placed.groupBy(*group, "_list", "_flt", "entry", "exit").agg(F.min("_id").alias("_first"), row_count().alias("set_size"))
    own = placed.select("_id", F.col("_flt").alias("_own_flt"), F.col("entry").alias("_own"))
    met = inside(own, sets, "_own", "entry", "exit").filter(F.col("_id") > F.col("_first"))
    kind = F.when((F.col("_own") == F.col("entry")) & (F.col("_own_flt") == F.col("_flt")), "EXACT_DUPLICATE").otherwise("OVERLAPPING_PREFIX")
    return met.select(*group, F.col("_first").alias("stat_1"), F.col("_id").alias("stat_2"),
                      F.col("_list").alias("column_list"), kind.alias("duplicate_type"), "set_size")


def normalised_keys(text: Column) -> Column:
    """Comma list of identifiers to a clean array: no brackets, no blanks, lower case."""
    clean = F.lower(F.regexp_replace(text, r"[\[\] ]", ""))
    return F.filter(F.split(clean, ","), lambda x: x != "")


def compare_keys(wanted: DataFrame, existing: DataFrame, group: Sequence[str], keys: str = "keys",
                 name: str = "index_name") -> DataFrame:
    """How the existing key lists of an object relate to each wanted list.

    One row per wanted list, kind of match and common prefix length, with the number of
    existing indexes and the first of their names. Prefixes are joined, not lists: a prefix
    of length p that an index shares but does not continue is a match of length p.
    """
    group = list(group)
    g = [f"_g{i}" for i in range(len(group))]
    w = wanted.select(*[F.col(c).alias(a) for c, a in zip(group, g)], F.col(keys).alias("_w")).filter(F.size("_w") > 0).distinct()
    e = existing.select(*[F.col(c).alias(a) for c, a in zip(group, g)], F.col(keys).alias("_e"), F.col(name).alias("_name")).filter(F.size("_e") > 0)

    # every prefix of an existing list, with the column that follows it ('' at its end)
    steps = (e.withColumn("_len", F.explode(F.sequence(F.lit(1), F.size("_e"))))
             .select(*g, F.slice("_e", F.lit(1), F.col("_len")).alias("_prefix"),
                     F.coalesce(F.try_element_at("_e", F.col("_len") + 1), F.lit("")).alias("_next"), "_name")
             .groupBy(*g, "_prefix", "_next").agg(row_count().alias("_n"), F.min("_name").alias("_first")))
    # every prefix of a wanted list, with the column that follows it there
    asks = (w.withColumn("_len", F.explode(F.sequence(F.lit(1), F.size("_w"))))
            .withColumn("_prefix", F.slice("_w", F.lit(1), F.col("_len")))
            .withColumn("_ask", F.coalesce(F.try_element_at("_w", F.col("_len") + 1), F.lit(""))))
    met = salted_join(asks, steps, [*g, "_prefix"], "inner")
    # an index that goes on with the same column matches further on; drop it here
    stops = met.filter((F.col("_next") == "") | (F.col("_ask") == "") | (F.col("_next") != F.col("_ask")))
    kind = _kind(F.col("_next") == "", F.col("_ask") == "", F.col("_len"))
    return (stops.groupBy(*g, F.col("_w").alias("wanted_keys"), kind.alias("match_type"), F.col("_len").alias("prefix_length"))
            .agg(F.sum("_n").alias("indexes"), F.min("_first").alias("first_index"))
            .withColumnsRenamed(dict(zip(g, group))))


# Order of the kinds of match.
MATCH_RANK = {"EXACT_KEY_MATCH": 1, "MISSING_IS_PREFIX_OF_EXISTING": 2, "EXISTING_IS_PREFIX_OF_MISSING": 3,
              "PARTIAL_LEADING_MATCH": 4, "SAME_FIRST_KEY_ONLY": 5}


def matching_indexes(wanted: DataFrame, existing: DataFrame, group: Sequence[str], keys: str = "keys",
                     name: str = "index_name", carry: Sequence[str] = ()) -> DataFrame:
    """One row per wanted list and existing index that share leading columns: its name, kind of match,
    common prefix length and the columns `carry` of the index.

    The pairs of the result and those with a longer prefix in common are all that is met.
    """
    group, carry = list(group), list(carry)
    g = [f"_g{i}" for i in range(len(group))]
    w = wanted.select(*[F.col(c).alias(a) for c, a in zip(group, g)], F.col(keys).alias("_w")).filter(F.size("_w") > 0).distinct()
    e = existing.select(*[F.col(c).alias(a) for c, a in zip(group, g)], F.col(keys).alias("_e"), F.col(name).alias("index_name"), F.struct(F.lit(0), *carry).alias("_carry")).filter(F.size("_e") > 0)
    after = lambda c: F.coalesce(F.try_element_at(c, F.col("_len") + 1), F.lit(""))
    asks = w.withColumn("_len", F.explode(F.sequence(F.lit(1), F.size("_w")))).select(*g, "_w", "_len", F.slice("_w", F.lit(1), F.col("_len")).alias("_prefix"), after("_w").alias("_ask"))
    steps = e.withColumn("_len", F.explode(F.sequence(F.lit(1), F.size("_e")))).select(*g, F.slice("_e", F.lit(1), F.col("_len")).alias("_prefix"), after("_e").alias("_next"), "index_name", "_carry")
    met = salted_join(steps, asks, [*g, "_prefix"], "inner").filter((F.col("_next") == "") | (F.col("_ask") == "") | (F.col("_next") != F.col("_ask")))
    return met.select(*[F.col(a).alias(c) for c, a in zip(group, g)], F.col("_w").alias("wanted_keys"), "index_name", _kind(F.col("_next") == "", F.col("_ask") == "", F.col("_len")).alias("match_type"),
                      F.col("_len").alias("prefix_length"), *[F.col("_carry").getField(c).alias(c) for c in carry])


def _kind(ended: Column, asked_all: Column, length: Column) -> Column:
    """Kind of match at the longest common prefix, by which of the two lists ends there."""
    return band([(ended & asked_all, "EXACT_KEY_MATCH"), (ended, "EXISTING_IS_PREFIX_OF_MISSING"), (asked_all, "MISSING_IS_PREFIX_OF_EXISTING"), (length == 1, "SAME_FIRST_KEY_ONLY")], "PARTIAL_LEADING_MATCH")


# Order of the kinds of match, and the most indexes one table can have.
MATCH_RANK = {"EXACT_KEY_MATCH": 1, "MISSING_IS_PREFIX_OF_EXISTING": 2, "EXISTING_IS_PREFIX_OF_MISSING": 3,
              "PARTIAL_LEADING_MATCH": 4, "SAME_FIRST_KEY_ONLY": 5}
MOST_INDEXES = 1000


def evidence_text(wanted: DataFrame, matches: DataFrame, group: Sequence[str], keys: str = "keys", none: str = "[no relevant leading-key overlap]",
                  details: Column | None = None, tail: Column | None = None, most: int = MOST_INDEXES) -> DataFrame:
    """Every matching index of a wanted list by name, as one text ranked by kind, prefix length and name; a list
    without any gets a default. `matches` is the result of `matching_indexes`.

    `details` is a text inside the brackets (type, unique), `tail` one behind them (columns). A table has at
    most `most` indexes, so that many entries are the longest text; more end the job with a message.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in MATCH_RANK.items() for x in kv]), F.col("match_type"))
    entry = F.concat("index_name", F.lit(" ["), F.col("match_type"), F.coalesce(F.concat(F.lit("; "), details), F.lit("")) if details is not None else F.lit(""),
                     F.lit("; prefix="), F.col("prefix_length").cast("string"), F.lit("]"), F.coalesce(tail, F.lit("")) if tail is not None else F.lit(""))
    listed = F.collect_list(F.struct(rank.alias("r"), (-F.col("prefix_length")).alias("p"), F.col("index_name").alias("f"), entry.alias("t")))
    text = matches.groupBy(*group, F.col("wanted_keys").alias(keys)).agg(F.array_sort(listed).alias("m"))
    checked = F.when(F.size("m") <= most, F.array_join(F.col("m.t"), " | ")).otherwise(F.raise_error(F.lit(f"more than {most} indexes match one wanted list")))
    return (salted_join(wanted, text.select(*group, keys, checked.alias("evidence")), [*group, keys], "left")
            .withColumn("evidence", F.coalesce("evidence", F.lit(none))))


def benefit(df: DataFrame, table: str, equality: str, inequality: str, included: str, seeks: Column,
            cost: Column, impact: Column) -> DataFrame:
    """Score of a wanted index, its key list in normal form and a definition as text."""
    eq, ineq = F.col(equality), F.col(inequality)
    listed = F.concat_ws(",", eq, ineq)
    bare = F.regexp_replace(F.regexp_replace(F.concat_ws("_", eq, ineq), ", ", "_"), r"[\[\]]", "")
    text = F.concat(F.lit("INDEX IX_MI_"), F.col(table), F.lit("_"), bare, F.lit(" ON "), F.col(table), F.lit(" ("), listed, F.lit(")"),
                    F.coalesce(F.concat(F.lit(" INCLUDE ("), F.col(included), F.lit(")")), F.lit("")))
    score = (seeks.try_cast("decimal(18,0)") * cost.try_cast("decimal(18,4)") * impact.try_cast("decimal(9,2)") / 100).cast("decimal(38,4)")
    return df.withColumns({"score": score, "normalised_keys": F.array_join(normalised_keys(listed), ","), "definition": text})


def usage_class(objects: DataFrame, usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects by use: written only, not used at all, or read. `usage` has reads and writes."""
    per = usage.groupBy(*keys).agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))
    rows = objects.join(per, list(keys), "left").withColumns({
        "reads": F.coalesce("reads", F.lit(0)), "writes": F.coalesce("writes", F.lit(0))})
    return rows.withColumn("usage", band([((F.col("reads") == 0) & (F.col("writes") > 0), "WRITE_ONLY_CANDIDATE"),
                                          ((F.col("reads") == 0) & (F.col("writes") == 0), "ZERO_USAGE")], "HAS_READS"))
