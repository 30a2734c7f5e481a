"""Personal data: patterns, and terms that reveal a protected entity.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. From the whole texts that hold them
(the protected entities) terms are gathered, and corpus counts tell how strongly a term reveals an entity:
PMI(e; t) / IC(e), with PMI = log p(e, t) / (p(e) p(t)) and IC = -log p(e) (Sanchez and Batet, 2016). It is
1 if the term occurs with the entity only. Terms at or above a first threshold are generalised, at or above a second removed.

DataFrame functions only: patterns run in the JVM and positions come from the lengths of what lies between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm.spread import BROADCAST_ROWS, fresh, kept, keyed_join

#: Kinds of base spans, in order.
KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain patterns of the operator's contract, written so that no engine has to
#: back out of a repetition or to try the middle of a run again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Different texts in which a term must stand with an entity; letters of a term at least.
SUPPORT, LETTERS = 3, 1
GENERALISE, REMOVE = 0.8, 0.95
#: Matches whose places are put together at once.
BLOCK = 256
_WORD = r"\p{L}+"
_EMPTY = "cast(array() as array<struct<start:int,ord:int,end:int,kind:string,value:string>>)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.transform(places, doubled), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """Whether a match of a pattern is personal data."""
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255)
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(x)).between(12, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column | str, kind: str, order: int) -> Column:
    """(start, ord, end, kind, value) of all matches: code points, end exclusive. The lengths of the parts between matches give the places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    kind_of = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"

    def place(acc: Column, p: Column) -> Column:
        at = acc["at"] + p["gap"]
        end = at + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), p["m"].alias("value"))).cast(kind_of)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(acc["at"].alias("at"), F.expr(_EMPTY).alias("out")), place)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    def placed(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(pairs) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind_of}>)").alias("out")), block, lambda acc: acc["out"]))

    # appending copies a list, so lists are put together in blocks; the one-element array names the matches, which are found once
    return F.transform(F.array(pairs), placed)[0]


def of_kind(kind: str):
    """A test of spans for a kind."""
    return lambda s: s["kind"] == kind


def _test(kind: str):
    return lambda s: _holds(kind, s["value"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind; empty for null."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    parts = [F.when(may[k], F.filter(matches(text, PATTERNS[k], k, n), _test(k))).otherwise(F.expr(_EMPTY)) for n, k in enumerate(KINDS)]
    return F.coalesce(F.sort_array(F.concat(*parts)), F.expr(_EMPTY))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def revealing_terms(found: DataFrame, docs: DataFrame, text: str, support: int = SUPPORT, generalise: float = GENERALISE, letters: int = LETTERS) -> DataFrame:
    """(entity, term, degree): terms whose disclosure degree of an entity is ``generalise`` or more.

    ``found`` has id, text and spans of the rows that have base spans. Only terms of ``letters`` letters or more that stand in
    ``support`` different texts with an entity are candidates; their counts are taken over all ``docs``.
    """
    each = found.select("id", "text", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"])))).alias("entity"))
    # an entity in too few texts has no term with support
    held = kept(each.groupBy("entity").agg(F.count_distinct("h").alias("texts"), F.count(F.lit(1)).alias("m")).filter(F.col("texts") >= support).select("entity", "m"))
    met = keyed_join(each, held, "entity", "m", max(1, found.count()), F.col("id")).filter("m is not null")
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    with_rows = met.select("id", "h", "entity", F.explode(terms).alias("term")).filter(F.length("term") >= letters)
    pairs = with_rows.groupBy("entity", "term", "h").agg(F.count_distinct("id").alias("n")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_both")).filter(F.col("texts") >= support)
    entities = each.select("id", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = kept(pairs.join(entities, "entity"))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("degree"))
    total = docs.count()

    def disclosing(counts: DataFrame) -> DataFrame:
        """Pairs whose degree is ``generalise`` or more by counts (term, n_term)."""
        pmi = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.greatest("n_term", "n_both")))
        ic = F.log(F.lit(float(total)) / F.col("n_entity"))
        return pairs.join(counts, "term").withColumn("degree", F.when(ic > 0, pmi / ic).otherwise(0.0)).filter(F.col("degree") >= generalise)

    # a term is in no fewer rows than with entities, so what these counts rule out the corpus rules out too
    with_counts = with_rows.select("id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    wanted = kept(disclosing(with_counts).select("term").distinct())
    if wanted.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("degree")).limit(0)
    small = wanted.count() <= BROADCAST_ROWS
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))).alias("term"))
    counts = words.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    return disclosing(counts).select("entity", "term", "degree")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: float = REMOVE, **options) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with base (spans), spans (base and terms) and clean (the text with all of them replaced), and these columns' names by role.

    A span is (start, ord, end, kind, value). Terms have the kind ``term``; those that overlap base spans are left out. In clean, a base
    span becomes its kind in brackets, a term its first letter and a full stop, or nothing at ``remove`` or above. Null texts have no spans.
    Rows are matched with their terms by id and text, so repeated rows and ids say the same.
    """
    names = {r: fresh(docs.columns, f"pii_{r}") for r in ("base", "spans", "clean")}
    with_base = docs.withColumn(names["base"], base_spans(F.col(text)))
    found = kept(with_base.filter(F.size(names["base"]) > 0).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(names["base"]).alias("spans")))
    risky = kept(revealing_terms(found, docs, text, **options))
    terms_of, by, of_text = (fresh([*docs.columns, *names.values()], x) for x in ("pii_terms", "pii_id", "pii_text"))
    if risky.isEmpty():
        out = with_base.withColumn(terms_of, F.expr("cast(null as array<struct<term:string,degree:double>>)"))
    else:
        of_entity = risky.groupBy("entity").agg(F.collect_list(F.struct("term", "degree")).alias("terms"))
        holders = found.select("id", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"])))).alias("entity"))
        sizes = holders.groupBy("entity").agg(F.count(F.lit(1)).alias("m"))
        met = keyed_join(holders, of_entity.join(sizes, "entity"), "entity", "m", max(1, found.count()), F.col("id")).filter("terms is not null")
        own = met.select("id", "h", F.explode("terms").alias("t")).groupBy("id", "h", "t.term").agg(F.max("t.degree").alias("degree")).groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("term", "degree"))).alias("terms"))
        own = kept(own.select(F.col("id").alias(by), F.col("h").alias(of_text), F.col("terms").alias(terms_of)))
        own = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
        out = with_base.join(own, F.col(doc_id).eqNullSafe(F.col(by)) & (F.xxhash64(text) == F.col(of_text)), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform(terms_of, lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    terms = F.when(F.col(terms_of).isNotNull(), F.filter(matches(F.col(text), pattern, "term", len(KINDS)), lambda s: ~F.exists(names["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(F.expr(_EMPTY))
    out = out.withColumn(names["spans"], F.sort_array(F.concat(names["base"], F.coalesce(terms, F.expr(_EMPTY)))))

    def shown(s: Column) -> Column:
        strong = F.exists(F.coalesce(terms_of, F.expr("cast(array() as array<struct<term:string,degree:double>>)")), lambda t: (t["term"] == F.lower(s["value"])) & (t["degree"] >= remove))
        return F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(strong, "").otherwise(F.concat(F.substring(s["value"], 1, 1), F.lit(".")))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), shown(s)))
        return F.struct(F.when(fits, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"), F.when(fits, more).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    clean = F.aggregate(names["spans"], F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step, rest)
    return out.withColumn(names["clean"], F.when(F.size(names["spans"]) > 0, clean).otherwise(F.col(text))).select(*docs.columns, *names.values()), names
