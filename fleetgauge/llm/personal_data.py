"""Personal data in text: labelers that vote, their estimated reliabilities, a span classifier.

Candidates are all matches of the base patterns, valid or not, and of looser ones (an address
spelled with "at" and "dot", a telephone number without its plus sign). Three labelers vote on
each: the strict form of its kind, a gazetteer of known endings and prefixes, and the words just
before it. Expectation-maximisation over the vote patterns estimates, without labels, how often
each labeler is right for each kind. Its posteriors are the soft labels from which the span
classifier (naive Bayes over votes, shape and neighbourhood) is trained. Valid base spans always
stay; other candidates are added if the classifier is sure and they touch no base span.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.session import write_once

#: In the order that ties between spans follow.
KINDS = ("email", "ip", "card", "phone")

# The four base patterns. They match what the plain forms match: a run is entered
# at its start or where the match before ended, and given up whole, so no text takes long.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
MARKS = {"email": "@", "ip": ".", "phone": "+"}
#: Endings, prefixes and words before a span that speak for its kind.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|be)$",
    "ip": r"^(?!0|127\.|10\.|192\.168\.|22[4-9]|2[3-9][0-9]|255)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^(?:\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel|adresse)[^\p{L}]{0,6}$",
    "ip": r"(?i)(?:\bip|host|server|address|login|from|client)[^\p{L}]{0,6}$",
    "card": r"(?i)(?:card|visa|credit|amex|karte|carte|tarjeta|account)[^\p{L}]{0,6}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|appelez|llame)[^\p{L}]{0,6}$",
}
NOT_CONTEXT = r"(?i)(?:version|section|isbn|issn|page|vol|no|nr|id|token)[^\p{L}]{0,6}$"
#: Characters before a span that the context labeler sees.
CONTEXT_CHARS = 24
ROUNDS = 8
#: A long text is cut in pieces of this many code points before spans are replaced, so that it is walked once.
CHUNK = 4096
#: Probability from which a candidate that is no base span is added.
SURE = 0.9


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join, neutral: int) -> Column:
    """Running sums, maxima or minima of an array of whole numbers, by steps of doubling reach: n log n."""

    def step(a: Column, j: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(neutral).cast("bigint"), F.call_function("shiftleft", F.lit(1), j)), a)
        return F.zip_with(a, F.slice(before, F.lit(1), F.size(a)), join)

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(values))) - 1), values, step)


def _found(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Matches as structs (start, kind number, stop, kind, hit, base, lead): running sums of the lengths
    of the parts between the matches and of the matches are the positions, in code points."""
    first = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:bigint,k:int,stop:bigint,kind:string,hit:string,base:boolean,lead:string>>)")

    def placed(hits: Column) -> Column:
        def walk(parts: Column) -> Column:
            lengths = F.zip_with(parts, hits, lambda p, h: (F.length(p) + F.coalesce(F.length(h), F.lit(0))).cast("bigint"))
            one = lambda ends: lambda hit, i: F.struct(
                (F.get(ends, i) - F.length(hit)).cast("bigint").alias("start"), F.lit(first).alias("k"), F.get(ends, i).alias("stop"), F.lit(kind).alias("kind"),
                hit.alias("hit"), F.lit(base).alias("base"), F.right(F.get(parts, i), F.lit(CONTEXT_CHARS)).alias("lead"))
            return _let(_running(lengths, lambda x, y: x + y, 0), lambda ends: F.transform(hits, one(ends)))

        return F.when(F.size(hits) > 0, _let(F.split(text, pattern, -1), walk)).otherwise(empty)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if base and kind in MARKS:
        return F.when(F.contains(text, F.lit(MARKS[kind])), _let(hits, placed)).otherwise(empty)
    return _let(hits, placed)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    n = F.length(_digits(hit))
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
            .when(kind == "card", F.when(n.between(14, 19), _luhn(_digits(hit))).otherwise(F.lit(False))).otherwise(n.between(10, 15)))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_spans`: every candidate with `ok` (a valid base span), in order."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = [_found(value, k, PATTERNS[k], True) for k in KINDS]
    every += [F.when(value.rlike(r"[\[(](?:at|dot)[\])]"), _found(value, "email", LOOSE["email"], False)).otherwise(F.expr("cast(array() as array<struct<start:bigint,k:int,stop:bigint,kind:string,hit:string,base:boolean,lead:string>>)")),
              _found(value, "phone", LOOSE["phone"], False)]
    checked = F.transform(F.concat(*every), lambda x: F.struct(*[x[f].alias(f) for f in ("start", "k", "stop", "kind", "hit", "base", "lead")], (x["base"] & _valid(x["kind"], x["hit"])).alias("ok")))
    return docs.withColumn("_spans", F.sort_array(checked))


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    out = F.lit(False)
    for k, p in patterns.items():
        out = F.when(kind == k, value.rlike(p)).otherwise(out)
    return out


VOTES = ("v1", "v2", "v3")


def votes(x: Column) -> dict[str, Column]:
    """Votes on a candidate: 1 for, 0 against, null abstains."""
    kind, hit, lead = x["kind"], x["hit"], x["lead"]
    return {"v1": F.when(x["base"], x["ok"].cast("int")),
            "v2": _by_kind(kind, GAZETTEER, F.when(kind == "card", _digits(hit)).otherwise(hit)).cast("int"),
            "v3": F.when(_by_kind(kind, CONTEXT, lead), 1).when(lead.rlike(NOT_CONTEXT), 0)}


def features(x: Column, vote: dict[str, Column]) -> Column:
    """Features of a candidate; fewer than 100 different ones per kind, whatever the texts."""
    groups = F.least(F.size(F.split(x["hit"], "[^A-Za-z0-9]+")), F.lit(9))
    before = F.right(x["lead"], F.lit(1))
    near = F.when(before == "", "none").when(before.rlike(r"\s"), "space").when(before.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark")
    return F.array(F.concat(F.lit("groups "), groups), F.concat(F.lit("length "), F.least(F.length(x["hit"]), F.lit(40))), F.concat(F.lit("before "), near),
                   *[F.concat(F.lit(f"{v} "), F.coalesce(c, F.lit(-1))) for v, c in vote.items()])


def posterior(rows: DataFrame) -> DataFrame:
    """Adds `posterior`: the chance of a true span given its votes and the reliabilities beside it."""
    odds = F.log("prior") - F.log1p(-F.col("prior"))
    for v in VOTES:
        t, f = F.col(f"t{v}"), F.col(f"f{v}")
        odds = odds + F.when(F.col(v) == 1, F.log(t / f)).when(F.col(v) == 0, F.log((1 - t) / (1 - f))).otherwise(0.0)
    return rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))


def reliabilities(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per kind: `prior` and, per labeler, how often it votes for true (`t`) and for
    other spans (`f`), by expectation-maximisation over the vote patterns.

    `voted` has kind, v1 to v3 and n. There are at most 4 * 3 * 2 * 3 patterns, whatever the
    number of spans; each round is an aggregate over these.
    """
    patterns = write_once(voted.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")), "votes")
    state = patterns.groupBy("kind").agg(F.lit(0.5).alias("prior"), *[F.lit(x).alias(f"{c}{v}") for v in VOTES for c, x in (("t", 0.8), ("f", 0.2))])
    for _ in range(rounds):
        scored = posterior(patterns.join(F.broadcast(state), "kind"))
        yes, no = F.col("n") * F.col("posterior"), F.col("n") * (1 - F.col("posterior"))
        aggs = [((F.sum(yes) + 1) / (F.sum("n") + 2)).alias("prior")]
        for v in VOTES:
            for c, w, lean in (("t", yes, 1.6), ("f", no, 0.4)):
                # two votes seen beforehand keep a rate off 0 and 1, and say which way it leans
                aggs.append(((F.sum(F.when(F.col(v) == 1, w).otherwise(0.0)) + lean) / (F.sum(F.when(F.col(v).isNotNull(), w).otherwise(0.0)) + 2)).alias(f"{c}{v}"))
        state = scored.groupBy("kind").agg(*aggs)
    return write_once(state, "reliabilities")


def train(spans: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of the span classifier by "kind feature", and its "kind" biases.

    `spans` has one candidate per row in `x`. Candidates are first counted by kind, votes and
    features, of which there is a bounded number; the weights that come to the driver are fewer
    than 400 numbers.
    """
    vote = votes(F.col("x"))
    counted = write_once(spans.select(F.col("x.kind").alias("kind"), *[c.alias(v) for v, c in vote.items()], features(F.col("x"), vote).alias("features"))
                         .groupBy("kind", *VOTES, "features").agg(F.count("*").alias("n")), "span-counts")
    soft = posterior(counted.join(F.broadcast(reliabilities(counted, rounds)), "kind"))
    yes, no = F.sum(F.col("n") * F.col("posterior")), F.sum(F.col("n") * (1 - F.col("posterior")))
    each = soft.withColumn("feature", F.explode("features")).groupBy("kind", "feature").agg(yes.alias("yes"), no.alias("no"))
    whole = soft.groupBy("kind").agg(yes.alias("_yes"), no.alias("_no"))
    weight = F.log((F.col("yes") + 0.5) / (F.col("_yes") + 1)) - F.log((F.col("no") + 0.5) / (F.col("_no") + 1))
    rows = each.join(F.broadcast(whole), "kind").select("kind", "feature", weight.alias("weight"), F.log((F.col("_yes") + 1) / (F.col("_no") + 1)).alias("bias")).collect()
    return {f"{r.kind} {r.feature}": r.weight for r in rows} | {r.kind: r.bias for r in rows}


def split_spans(rows: DataFrame, weights: dict[str, float], sure: float = SURE) -> DataFrame:
    """Adds `_base` and `_added` to rows with `_spans`: arrays of (start, k, stop, kind) in order."""
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair]) if weights else F.expr("cast(map() as map<string,double>)")

    def short(xs: Column) -> Column:
        return F.transform(xs, lambda x: F.struct(*[x[f].alias(f) for f in ("start", "k", "stop", "kind")]))

    def accepted(x: Column) -> Column:
        odds = F.aggregate(features(x, votes(x)), F.coalesce(table[x["kind"]], F.lit(-99.0)), lambda a, f: a + F.coalesce(table[F.concat(x["kind"], F.lit(" "), f)], F.lit(0.0)))
        return odds >= F.log(F.lit(sure / (1 - sure)))

    rows = rows.withColumn("_base", short(F.filter("_spans", lambda x: x["ok"])))
    # in order of starts, a span meets a base span before it that ends later than it starts, or one behind it that
    # starts before it ends
    far = 1 << 62
    ends = _running(F.transform("_spans", lambda x: F.when(x["ok"], x["stop"]).otherwise(F.lit(0).cast("bigint"))), lambda x, y: F.greatest(x, y), 0)
    starts = F.reverse(_running(F.reverse(F.transform("_spans", lambda x: F.when(x["ok"], x["start"]).otherwise(F.lit(far).cast("bigint")))), lambda x, y: F.least(x, y), far))
    free = _let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda met: F.filter(
        "_spans", lambda x, i: ~x["ok"] & (F.get(met["ends"], i) <= x["start"]) & (F.get(met["starts"], i) >= x["stop"]) & accepted(x)))
    return rows.withColumn("_added", F.when(F.size("_spans") > F.size("_base"), F.array_distinct(short(free))).otherwise(F.slice("_base", 1, 0)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """Per document row: doc_id, base spans per kind, base_sha256, spans (base and added), n_added.

    Positions are code points, stop exclusive. Each row is a document, whatever its id. Null
    and empty texts have no spans; an empty table trains nothing and returns no rows. Columns
    other than the two are not read.
    """
    rows = candidates(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).select("doc_id", "_spans")
    rows = write_once(rows, "spans")
    done = split_spans(rows, train(rows.select(F.explode("_spans").alias("x")), rounds), sure)

    def number(kind: str) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")

    return done.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_added"))


def _cut(text: Column, spans: Column) -> Column:
    """The text with its spans, in order of starts, replaced by their kinds; those that overlap become one."""
    ends = _running(F.transform(spans, lambda x: x["stop"]), lambda x, y: F.greatest(x, y), 0)

    def body(v: Column) -> Column:
        chunks, ends = v["chunks"], v["ends"]
        get = lambda i: F.coalesce(F.get(chunks, i.cast("int")), F.lit(""))

        def part(lo: Column, hi: Column) -> Column:
            a, b = F.floor(lo / CHUNK), F.floor(hi / CHUNK)
            at, to = (lo % CHUNK + 1).cast("int"), (hi % CHUNK).cast("int")
            apart = F.concat(F.substring(get(a), at, F.lit(CHUNK)), F.array_join(F.slice(chunks, (a + 2).cast("int"), (b - a - 1).cast("int")), ""), F.substring(get(b), F.lit(1), to))
            return F.when(hi <= lo, "").when(a == b, F.substring(get(a), at, (hi - lo).cast("int"))).otherwise(apart)

        def one(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))
            return F.when(x["start"] >= before, F.concat(part(before, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")

        return F.concat(F.array_join(F.transform(spans, one), ""), part(F.element_at(ends, -1), F.length(text).cast("bigint")))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), ends.alias("ends")), body)


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets, and `n_chars` brought up to
    date if there is one. Spans that overlap become one. Null texts stay null."""
    packed = candidates(docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_text")), "_text")
    done = split_spans(packed, train(packed.select(F.explode("_spans").alias("x")), rounds), sure)
    done = done.withColumn("_cuts", F.sort_array(F.concat("_base", "_added")))
    clean = F.when(F.size("_cuts") == 0, F.col("_text")).otherwise(_cut(F.col("_text"), F.col("_cuts")))
    done = done.select("_row", clean.alias("_clean"))
    return done.select(*[F.col("_clean").alias(c) if c == text else F.length("_clean").cast(docs.schema[c].dataType).alias(c) if c == n_chars else F.col("_row").getField(c).alias(c) for c in docs.columns])
