"""Personal data by patterns and information-theoretic sanitisation (DataFrame functions only).

Base spans come from four patterns.  Every matched value is a protected entity.  The corpus tells how
strongly the words around it reveal it: with document counts n(e), n(t) and n(t, e) (word t stands within CONTEXT
characters of e), pointwise mutual information of t and e, divided by the information content of e, is
1 - log p(e|t) / log p(e).  Where that share reaches DISCLOSED, t is disclosing: next to e it is removed if it never
stands without e, else generalised.  Pairs of fewer than SUPPORT documents are judged by p(e|t) = n(t, e) / (n(t) + 1),
as if one more document held t without e; so entities of one document count too, and chance tells less.

Positions come from regular splits: the text between matches and the matches themselves, added up.
Patterns are written with possessive repeats and look-behind, so that no text makes them slow; they
match what the plain ones do.  Texts are cut through blocks of CUT characters and sums run over blocks of SCAN items,
so the work of a text follows its length and the number of its spans, not their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked_ids, stored, unused

CONTEXT, DISCLOSED, SUPPORT = 60, 0.9, 3
#: Up to so many terms are broadcast; more are joined by key.  A term lies whole within CONTEXT characters, so this is some 24 MB.
BROADCAST_TERMS = 100_000
HOT_TERMS = 50_000
TERM = r"\p{L}{3,}+"
SCAN, CUT_BITS = 128, 10
CUT = 1 << CUT_BITS
KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without such a piece has no match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def weigh(k: Column) -> Column:
        x = F.ascii(F.substring(turned, k, F.lit(1))) - 48
        return F.when(k % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda s: _valid(kind, s["value"])


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once."""
    return F.transform(F.array(x), body)[0]


def before_each(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (array<int>) join, a sum or maximum from 0 on, of those before it; block by block."""

    def run(items: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def whole(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / SCAN).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: run(F.slice(v, b * SCAN + 1, F.lit(SCAN)), lambda x: x))
        return bound(blocks, lambda own: F.flatten(F.zip_with(run(own, lambda x: x["at"])["out"], own, lambda first, x: F.transform(x["out"], lambda y: join(first, y)))))

    return bound(values, whole)


def added(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches, leftmost first, as array<kind, start, end, value>; code points, end exclusive."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g))
        pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), F.length(v).alias("n"), v.alias("value")))
        return bound(pairs, lambda own: F.zip_with(own, before_each(F.transform(own, lambda x: x["gap"] + x["n"]), added), span))

    def span(x: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def blocks_of(text: Column) -> Column:
    """The text in blocks of CUT characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}+"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive), found in the blocks that hold them."""
    first = F.shiftright(start, CUT_BITS)
    n = F.shiftright(F.greatest(end - 1, start), CUT_BITS) - first + 1
    return F.substring(F.array_join(F.slice(blocks, first + 1, n), ""), start - first * CUT + 1, F.greatest(end - start, F.lit(0)))


def rebuilt(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with by(span, end of the spans before) for what the spans cover.  spans: start, end, ..., sorted by start."""

    def pieces(blocks: Column, own: Column) -> Column:
        before = before_each(F.transform(own, lambda s: s["end"]), F.greatest)
        parts = F.zip_with(own, before, lambda s, at: F.concat(F.when(s["start"] > at, cut(blocks, at, s["start"])).otherwise(F.lit("")), by(s, at)))
        end = F.coalesce(F.array_max(F.transform(own, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), cut(blocks, end, F.length(text)))

    return bound(blocks_of(text), lambda blocks: bound(spans, lambda own: pieces(blocks, own)))


def base_spans(text: Column) -> Column:
    """The valid base spans of a text (null: none), by kind as listed, then start."""
    none = F.array().cast(f"array<{_SPAN}>")
    per_kind = []
    for kind in KINDS:
        may = F.rlike(text, F.lit("[0-9]")) if kind != "email" else F.lit(True)
        if _NEEDS[kind]:
            may = F.contains(text, F.lit(_NEEDS[kind])) & may
        may = may & F.rlike(text, F.lit(PATTERNS[kind]))
        spans = F.filter(located(text, PATTERNS[kind], kind), _validity(kind))
        per_kind.append(F.when(may, spans).otherwise(none))
    return F.concat(*per_kind)


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _contexts(spans: Column, text: Column) -> Column:
    """For each span: entity, and the terms (runs of letters outside all spans) whole within CONTEXT characters."""
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    masked = rebuilt(text, places, lambda s, at: F.repeat(F.lit("0"), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))

    def around(s: Column, blocks: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))

        def terms(piece: Column) -> Column:
            whole = F.length(piece) < s["end"] + CONTEXT - low
            found = F.filter(located(piece, TERM, "term"), lambda t: ((t["start"] > 0) | (low == 0)) & ((t["end"] < F.length(piece)) | whole))
            return F.transform(found, lambda t: F.struct(F.lower(t["value"]).alias("term"), (t["start"] + low).alias("start"), (t["end"] + low).alias("end")))

        return F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), bound(cut(blocks, low, s["end"] + CONTEXT), terms).alias("terms"))

    return bound(blocks_of(masked), lambda blocks: F.transform(spans, lambda s: around(s, blocks)))


def _key(id_: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.hex(F.xxhash64(text)))


def disclosing_terms(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """entity, term, share (p(e|t)) of the disclosing pairs.  docs: text; mentions: key, entity, terms."""
    near = stored(mentions.select("key", "entity", F.explode(F.array_distinct(F.col("terms.term"))).alias("term")).distinct(), "pii-near")
    n_docs = docs.count()
    n_te = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    n_e = mentions.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    # documents that hold t near any entity: never more than n(t), so terms that fail with it fail with n(t) too
    n_near = stored(near.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near")), "pii-near-counts")

    def reveals(n_t: str) -> Column:
        """1 - log p(e|t) / log p(e) >= DISCLOSED; an entity of all documents says nothing."""
        more = F.when(F.col("n_te") < SUPPORT, 1).otherwise(0)
        return (F.col("n_e") < n_docs) & (F.log(F.col("n_te") / (F.greatest(n_t, "n_te") + more)) >= (1 - DISCLOSED) * F.log(F.col("n_e") / F.lit(float(n_docs))))

    # terms near very many entities meet their count by a broadcast of at most HOT_TERMS rows
    hot = F.col("n_near") > max(256, (n_near.agg(F.sum("n_near")).first()[0] or 0) // HOT_TERMS)
    tagged = n_te.join(n_e, "entity").join(F.broadcast(n_near.where(hot)), "term", "left")
    others = tagged.where("n_near is null").drop("n_near").join(n_near.where(~hot), "term")
    both = tagged.where("n_near is not null").unionByName(others)
    pairs = stored(both.where(reveals("n_near")), "pii-pairs")

    def counted(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
        """pairs with the number of docs that hold their term."""
        terms = stored(pairs.select("term").distinct(), "pii-terms")
        words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
        few = terms.count() <= BROADCAST_TERMS
        # many terms: words are added up where they are read, before they move
        sums = (words.join(F.broadcast(terms), "term") if few else words).groupBy("term").agg(F.count("*").alias(name))
        return pairs.join(sums, "term", "left").withColumn(name, F.coalesce(name, F.lit(0)))

    # a sixteenth of the texts is another bound from below, and spares the full count most of the common words
    if pairs.limit(1).count():
        pairs = stored(counted(pairs, docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0), "n_part").where(reveals("n_part")), "pii-pairs")
    if not pairs.limit(1).count():
        return pairs.select("entity", "term", F.lit(1.0).alias("share"))
    return counted(pairs, docs, "n_t").where(reveals("n_t")).select("entity", "term", (F.col("n_te") / F.greatest("n_t", "n_te")).alias("share"))


def term_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """key, terms (array<start, end, share>) of the texts with disclosing terms.  spans: key, text, base."""
    mentions = stored(spans.select("key", F.inline(_contexts(F.col("base"), F.col("text")))), "pii-mentions")
    shown = stored(disclosing_terms(docs, mentions), "pii-disclosing")
    found = mentions.select("key", "entity", F.inline("terms")).join(shown, ["entity", "term"])
    found = found.groupBy("key", "start", "end").agg(F.max("share").alias("share"))
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))  # of one text


def _with_base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("base", base_spans(F.col("text"))).withColumn("key", _key(F.col("id"), F.col("text")))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, base (array of spans), terms (array<start, end, share>).

    Null texts are empty; very long ones are read whole, in work that follows their length and spans.  Repeated rows count as one
    document in the corpus counts and each get their row, and so do rows with null ids.  Terms that several entities
    disclose have the largest share.  An empty table gives no rows; other columns are not read, whatever their names.
    """
    marked = _with_base(df, id_col, text_col)
    rows = stored(marked.select("id", "key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii-base")
    hit = stored(rows.where("text is not null").select("key", "text", "base").dropDuplicates(["key"]), "pii-hit")
    terms = stored(term_spans(marked.select("text"), hit), "pii-terms-of")
    return rows.select("id", "key", "base").join(terms, "key", "left").select(F.col("id").alias(id_col), "base", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,share:double>>")).alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans replaced by [KIND], terms removed (share 1) or generalised to [TERM]."""
    spans = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by"))),
        F.transform(terms, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), F.when(s["share"] >= 1, F.lit("")).otherwise(F.lit("[TERM]")).alias("by"))),
    )
    return rebuilt(text, F.array_sort(spans), lambda s, at: F.when(s["start"] >= at, s["by"]).otherwise(F.lit("")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every text sanitised; all columns and rows stay, whatever their names, and null texts stay null.

    Base spans are looked for once in each text.  Only texts with one (marked by a map of hashed keys) are joined or changed.
    Repeated rows and rows with null ids are changed alike; an empty table stays empty.
    """
    marked = _with_base(docs, id_col, text_col)
    hit = stored(marked.where(F.size("base") > 0).select("key", "text", "base").dropDuplicates(["key"]), "pii-hit")
    terms = stored(term_spans(marked.select("text"), hit), "pii-terms-of")
    key, may, base, shown = unused(docs, "__key", "__may", "__base", "__terms")
    own = hit.select(F.col("key").alias(key), F.col("base").alias(base)).join(terms.select(F.col("key").alias(key), F.col("terms").alias(shown)), key, "left")
    keyed = docs.withColumn(key, _key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    flagged = marked_ids(keyed, hit.select(F.col("key").alias("id")), hit.count(), key, may)
    dirty = flagged.where(F.col(may)).join(own, key, "left")
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    clean_text = sanitised(F.col(f"`{text_col}`"), F.col(base), F.coalesce(shown, none))
    dirty = dirty.withColumn(text_col, F.when(F.col(base).isNull(), F.col(f"`{text_col}`")).otherwise(clean_text))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return flagged.where(~F.col(may)).select(*columns).unionAll(dirty.select(*columns))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of find_personal_data's spans."""
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = rendered(F.col("base"))
    added = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lit("").alias("value")))
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), rendered(F.concat("base", added)).alias("spans"))
