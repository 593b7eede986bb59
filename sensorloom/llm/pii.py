"""Personal data: fixed forms, and identifiers found by bootstrapped context patterns. DataFrame functions only.

The fixed forms (email, ip, card, phone) are the seeds. The words around a seed
are its patterns. Patterns and instances make a graph that is scored in rounds: a
pattern is as good for a kind as the share of the kind's known instances among all
known ones and the tokens whose shape does not fit the kind (a token that fits and is
not known yet says nothing against it); a token of a fitting shape is as likely an
identifier as the patterns around it make it. Accepted instances are known in the next
round and teach further patterns, until a round accepts none. Spans of accepted tokens
are added; those of the fixed forms always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, whole, words
from sensorloom.plans.staging import staged

KINDS = ("email", "ip", "card", "phone")

# A match begins where a run of its first characters begins, or where the match before it ended: later
# starts in a run find the same or less. With possessive runs, long runs take linear time and no stack.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer than 13 digits would be dropped afterwards; they hold no longer run, so the look-ahead skips them.
_CARD = r"(?:(?<![0-9])|\G)(?=(?:[0-9][\x20-]?){12}[0-9])[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Numbers of several groups (of five digits at most, joined by blanks, dots, hyphens, slashes, brackets), else words
# with an @ or at least four digits.
_GROUPS = r"(?<![^\x20\x09-\x0D(:;,'\x22=<\[])(?:\((?=[0-9]{1,5}\)))?+\+?+[0-9]{1,5}+(?![0-9A-Za-z])(?:[\x20().\x2F-]{1,3}+[0-9]{2,5}+(?![0-9A-Za-z]))++"
_TOKEN = _GROUPS + r"|(?<![^\x20\x09-\x0D])(?:(?:[^\x20\x09-\x0D0-9]*+[0-9]){4}|[^\x20\x09-\x0D@]*+@)[^\x20\x09-\x0D]*+"
# Dates, and spans of years, are no phones.
_DATE = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}(?![0-9])|(?:19|20)[0-9]{2}[-./ ]{1,3}(?:19|20)[0-9]{2}$)"

#: Characters around a span that its context words are taken from.
CONTEXT_CHARS = 80
#: Distinct known instances a pattern needs, and the least score of an accepted instance.
SUPPORT, ACCEPT = 5, 0.9

_P = "_p_"


def _c(name: str) -> Column:
    return F.col(_P + name)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        values = F.transform(F.array_remove(F.split(F.reverse(_digits(x)), ""), ""), lambda d, i: d.cast("int") * (1 + i % 2))
        luhn = F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0
        return F.length(_digits(x)).between(13, 19) & luhn
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _found(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds matches, the pieces between them, and their lengths in steps of 128, for places in linear time."""
    none = F.array().cast("array<string>")
    df = df.withColumn(_P + name, F.when(when, F.regexp_extract_all(_c("text"), F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(_c(name)) > 0
    df = df.withColumn(_P + name + "_gaps", F.when(some, F.split(_c("text"), pattern)).otherwise(none))
    gaps = _c(name + "_gaps")
    df = df.withColumn(_P + name + "_steps", F.transform(_c(name), lambda x, i: F.length(x) + F.length(F.get(gaps, i))))
    every = F.sequence(F.lit(0), F.floor(F.size(_c(name)) / 128).cast("int"))
    return df.withColumn(_P + name + "_sums", F.when(some, F.transform(every, lambda j: _total(F.slice(_c(name + "_steps"), j * 128 + 1, F.lit(128))))))


def _start(name: str, i: Column) -> Column:
    """Code points before match ``i``."""
    block = F.floor(i / 128).cast("int")
    return _total(F.slice(_c(name + "_sums"), F.lit(1), block)) + _total(F.slice(_c(name + "_steps"), block * 128 + 1, i - block * 128)) + F.length(F.get(_c(name + "_gaps"), i))


def _valid_spans(kind: str) -> Column:
    spans = F.transform(_c(kind), lambda x, i: F.struct(F.lit(kind).alias("kind"), _start(kind, i).cast("long").alias("start"), (_start(kind, i) + F.length(x)).cast("long").alias("end"), x.alias("value")))
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _word(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def _patterns(left: Column, right: Column) -> Column:
    """Two lexical patterns: the two words before, and the words on both sides."""
    before, after = words(left), words(right)
    one, two = F.coalesce(F.get(before, F.size(before) - 1), F.lit("^")), F.coalesce(F.get(before, F.size(before) - 2), F.lit("^"))
    behind = F.coalesce(F.get(after, F.lit(0)), F.lit("$"))
    return F.array(F.concat(_word(two), F.lit(" "), _word(one), F.lit(" _")), F.concat(_word(one), F.lit(" _ "), _word(behind)))


def _shape(kind: str, token: Column) -> Column:
    n = F.length(_digits(token))
    if kind == "email":
        return F.instr(token, "@") > 0
    if kind == "ip":
        return token.rlike(r"^[0-9A-Fa-f]*[.:][0-9A-Fa-f.:]+$")
    return n.between(*((12, 19) if kind == "card" else (7, 15))) & token.rlike(r"^[+(0-9][0-9().\x20/-]*$") & ~token.rlike(_DATE)


def base_mentions(docs: DataFrame) -> DataFrame:
    """One thin row for each document: doc_id, version (text hash), ``base`` spans with patterns, ``tokens`` that may be unseen identifiers."""
    df = docs.select(F.col("doc_id"), whole().alias(_P + "text"))
    digit = F.col(_P + "digit")
    df = df.withColumn(_P + "digit", _c("text").rlike("[0-9]"))
    at = F.instr(_c("text"), "@") > 0
    for name, pattern, when in (("email", _EMAIL, at), ("ip", _IP, digit), ("card", _CARD, digit), ("phone", _PHONE, digit & (F.instr(_c("text"), "+") > 0)), ("token", _TOKEN, digit | at)):
        df = _found(df, name, pattern, when)
    for kind in KINDS:
        df = df.withColumn(_P + "spans_" + kind, _valid_spans(kind))
    df = df.withColumn(_P + "base", F.concat(*[_c("spans_" + k) for k in KINDS]))
    n = CONTEXT_CHARS

    def context(s: Column) -> Column:
        start = s["start"].cast("int")
        low = F.greatest(start - n, F.lit(0))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _patterns(F.substring(_c("text"), low + 1, start - low), F.substring(_c("text"), s["end"].cast("int") + 1, F.lit(n))).alias("patterns"))

    base, tokens, gaps = _c("base"), _c("token"), _c("token_gaps")
    core = lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9@+(]+|[^A-Za-z0-9)]+$", "")
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"), _start("token", i).cast("long").alias("at")))
    # A token that meets a base span is no new identifier.
    free = F.filter(placed, lambda x: ~F.exists(base, lambda b: (b["start"] < x["at"] + F.length(x["t"])) & (x["at"] < b["end"])))
    df = df.withColumn(_P + "free", free)

    def unseen(x: Column) -> Column:
        start = x["at"] + F.length(F.regexp_extract(x["t"], r"^[^A-Za-z0-9@+(]*", 0))
        # The context on the left may hold the token before.
        left, right = F.concat(F.coalesce(F.get(tokens, x["i"] - 1), F.lit("")), F.get(gaps, x["i"])), F.coalesce(F.get(gaps, x["i"] + 1), F.lit(""))
        return F.struct(start.cast("long").alias("start"), core(x["t"]).alias("value"), _patterns(F.substring(left, F.greatest(F.length(left) - n, F.lit(0)) + 1, F.lit(n)), F.substring(right, F.lit(1), F.lit(n))).alias("patterns"))

    return df.select("doc_id", F.xxhash64(_P + "text", F.lit(6)).alias("version"), F.transform(base, context).alias("base"), F.transform(_c("free"), unseen).alias("tokens"))


def scored_instances(mentions: DataFrame, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(value, kind): unseen tokens accepted in any round; rounds go on until one accepts none. ``mentions``: written rows of :func:`base_mentions`.

    A pattern needs ``support`` distinct known instances of a kind and a word of its own. A
    token that fits several kinds has the kind of the highest score.
    """
    known = mentions.select(F.explode("base").alias("s")).select(F.col("s.value").alias("value"), F.col("s.kind").alias("kind"), F.explode("s.patterns").alias("pattern"))
    new = mentions.select(F.explode("tokens").alias("s")).select(F.col("s.value").alias("value"), F.explode("s.patterns").alias("pattern"))
    lexical = (F.col("value") != "") & F.col("pattern").rlike(r"\p{L}")
    fits = F.filter(F.array(*[F.when(_shape(k, F.col("value")), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    # Distinct edges before anything is joined: a common pattern or a copied text counts once for each instance.
    seeds = staged(known.where(lexical).groupBy("pattern", "value", "kind").agg(F.lit(1.0).alias("weight")), "pii-seeds")
    edges = staged(new.where(lexical).distinct().withColumn("fits", fits), "pii-edges")
    misfits = staged(edges.groupBy("pattern").agg(*[F.count_if(~F.array_contains("fits", k)).alias("not_" + k) for k in KINDS]), "pii-misfits")
    likely = edges.where(F.size("fits") > 0)
    accepted = edges.where(F.lit(False)).select("value", F.lit("").alias("kind"), F.lit(0.0).alias("weight"))
    while True:
        learnt = likely.join(accepted, "value")
        votes = seeds.unionByName(learnt.select("pattern", "value", "kind", "weight")).groupBy("pattern", "kind").agg(F.sum("weight").alias("good"), F.count(F.lit(1)).alias("n"))
        totals = votes.groupBy("pattern").agg(F.sum("n").alias("all"))
        # A known instance of one kind counts among all known ones, not as a misfit of another.
        judged = learnt.groupBy("pattern").agg(*[F.count_if(~F.array_contains("fits", k)).alias("known_not_" + k) for k in KINDS])
        against = F.coalesce(*[F.when(F.col("kind") == k, F.coalesce("not_" + k, F.lit(0)) - F.coalesce("known_not_" + k, F.lit(0))) for k in KINDS])
        good = votes.where(F.col("n") >= support).join(totals, "pattern").join(misfits, "pattern", "left").join(judged, "pattern", "left")
        good = good.select("pattern", "kind", (F.col("good") / (F.col("all") + against + 0.25)).alias("confidence"))
        open_edges = likely.join(accepted.select("value"), "value", "left_anti").join(good, "pattern").where(F.array_contains("fits", F.col("kind")))
        score = open_edges.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("weight"))
        best = score.where(F.col("weight") >= accept).groupBy("value").agg(F.max(F.struct("weight", "kind")).alias("b"))
        found = staged(best.select("value", "b.kind", "b.weight"), "pii-accepted")
        if found.isEmpty():
            return accepted.select("value", "kind")
        accepted = accepted.unionByName(found)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (arrays of kind, start, end in code points, end exclusive; by kind, then start).

    One row for each input row. Null and empty texts have no spans. Repeated rows
    get the same spans. Other columns are ignored.
    """
    mentions = staged(base_mentions(docs), "pii-mentions")
    accepted = scored_instances(mentions)
    tokens = mentions.where(F.size("tokens") > 0).select("doc_id", "version", F.explode("tokens").alias("s")).select("doc_id", "version", F.col("s.start").alias("start"), F.col("s.value").alias("value"))
    added = (
        tokens.join(accepted, "value").select("doc_id", "version", F.struct("kind", "start", (F.col("start") + F.length("value")).cast("long").alias("end")).alias("s"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_v")).agg(F.collect_set("s").alias("added"))
    )
    spans = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = mentions.select("doc_id", "version", spans.alias("base"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v")), "left")
    place = F.array(*map(F.lit, KINDS))
    both = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    ordered = F.transform(F.array_sort(F.transform(both, lambda s: F.struct(F.array_position(place, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(ordered).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op3_bootstrapped_pii")
def op3(spark, sf_dir):
    out = personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(_count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
