"""Personal data: exact patterns, and identifiers found by their context.

The exact patterns give the base spans. They also seed a bootstrap: one or two words to the left or right of a token are
lexical patterns, tokens that look like identifiers are instances, and each occurrence joins some of the first to one of
the second. Confidence flows over that graph in rounds of aggregates until nothing is added: a pattern is as sure as its
occurrences with believed instances are many among those and the contradicting ones, an instance as sure as the patterns
around it. A token that looks like the kind and is not believed yet neither supports nor contradicts. Believed instances
support further patterns, and are added to the spans.

All of it is column functions. Patterns are written so that Java's matcher neither recurses nor tries a run of characters
twice: characters that only count between two others are replaced first by one control character of the same width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.shared import SPACES, pick, positional, staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int>>"
MARK, OTHER = "\u0001", "\u0002"  # MARK stands for a character that joins its neighbours, OTHER for a MARK in the text

LOCAL = f"A-Za-z0-9._%+{MARK}-"
EMAIL = f"(?:(?<![{LOCAL}])|\\G)[{LOCAL}]++@(?=[A-Za-z0-9-]++{MARK})[A-Za-z0-9{MARK}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{MARK}]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
IP_PARTS = f"^{_PART}(?:\\.{_PART}){{3}}$"
# What an identifier of a kind must look like to be added to it.
LOOKS = {"email": "^[^@]+@[^@]+$", "ip": r"^(?=.*[0-9].*[0-9])[0-9A-Fa-f]+([.:][0-9A-Fa-f]*)+$",
         "card": r"^(?=(?:[^0-9]*[0-9]){12})[0-9 -]+$", "phone": r"^(?=(?:[^0-9]*[0-9]){6})[0-9+()./-]+$"}

SUPPORT = 3  # different seeds or believed instances that a pattern must have been seen with
PATTERN_CONFIDENCE = 0.8
INSTANCE_CONFIDENCE = 0.8
SMOOTHING = 0.5


def _joined(text: Column, between: str, characters: str) -> Column:
    """MARK for the characters that stand between two of ``between``; every character keeps its place."""
    return F.regexp_replace(F.translate(text, MARK, OTHER), f"(?<=[{between}])[{characters}](?=[{between}])", MARK)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before, after) of all matches: code points and the text up to the neighbour matches."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(matches, gaps, lambda match, gap: F.struct(
        F.length(gap).alias("gap"), F.length(match).alias("width"), match.alias("match"), gap.alias("before")))
    # One more gap than matches: the last piece has no match.
    pieces = F.filter(pieces, lambda piece: piece.match.isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,end:int,match:string,before:string>>").alias("found"))
    folded = F.aggregate(pieces, start, lambda acc, piece: F.struct(
        (acc.at + piece.gap + piece.width).alias("at"),
        F.concat(F.coalesce(acc.found, F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")), F.array(F.struct(
            (acc.at + piece.gap).alias("start"), (acc.at + piece.gap + piece.width).alias("end"),
            piece.match.alias("match"), piece.before.alias("before")))).alias("found")))
    return F.when(F.size(matches) > 0, folded.found)


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))),
                                 F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") + 1))
        .otherwise(F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the exact patterns by kind, then start; leftmost, non-overlapping within a kind."""
    digits = F.when(text.rlike("[0-9]"), text)
    found = {
        "email": located(F.when(F.contains(text, F.lit("@")), _joined(text, "A-Za-z0-9-", ".")), EMAIL),
        "ip": F.filter(located(F.when(digits.rlike(r"[0-9]\.[0-9]"), digits), IP), lambda m: m.match.rlike(IP_PARTS)),
        "card": F.filter(located(F.when(digits.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), _joined(digits, "0-9", r"\x20-")), CARD),
                         lambda m: F.length(_digits(m.match)).between(13, 19) & luhn(_digits(m.match))),
        "phone": F.filter(located(F.when(F.contains(digits, F.lit("+")), digits), PHONE),
                          lambda m: F.length(_digits(m.match)).between(9, 15)),
    }

    def tagged(kind: str) -> Column:
        return F.transform(found[kind], lambda m: F.struct(
            F.lit(kind).alias("kind"), m.start.cast("int").alias("start"), m.end.cast("int").alias("end")))

    return F.concat(*[F.coalesce(tagged(kind), F.array().cast(SPAN)) for kind in KINDS])


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _context(part: Column) -> Column:
    """Lower case, one space between words and none around them."""
    return F.trim(F.regexp_replace(F.lower(part), SPACES, " "))


def _around(parts: list[Column], count: int) -> Column:
    """The first (or, with a negative count, last) words of parts of a text."""
    return F.substring_index(F.array_join(F.filter(F.array(*parts), lambda part: part != ""), " "), " ", count)


def scanned(docs: DataFrame) -> DataFrame:
    """Stored rows: uid, doc_id, digest of the text, base spans, and tokens that hold a digit or an at sign with two words on both sides."""
    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    held = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    rows = rows.withColumn("found", located(held, TOKEN)).withColumn("base", base_spans(F.col("text")))
    # Parts of the text between tokens: what stands first and last in them.
    gaps = F.transform(F.transform(F.split(held, TOKEN, -1), _context), lambda gap: F.struct(
        F.substring_index(gap, " ", 2).alias("head"), F.substring_index(gap, " ", -2).alias("tail")))
    rows = rows.withColumn("gaps", F.when(F.col("found").isNotNull(), gaps))

    def token(i: Column) -> Column:
        return F.when(i >= 0, F.lower(F.get("found", i)["match"]))

    def tail(i: Column) -> Column:
        return F.when(i >= 0, F.get("gaps", i)["tail"])

    def seeded(t: Column, i: Column) -> Column:
        """The token with the seed that begins in it; tokens within a seed are no instances."""
        touching = F.filter("base", lambda s: (s.start < t.end) & (s.end > t.start))
        first = F.get(F.filter(touching, lambda s: s.start >= t.start), 0)
        more = F.when(first.isNotNull(), F.size(F.filter("found", lambda o: (o.start >= t.end) & (o.start < first.end))))
        last = i + F.coalesce(more, F.lit(0))
        return F.struct(t.start.cast("int").alias("start"), t.match.alias("token"), first.kind.alias("kind"),
                        F.substring("text", first.start + 1, first.end - first.start).alias("seed"),
                        (F.size(touching) > 0).alias("touched"),
                        _around([token(i - 2), tail(i - 1), token(i - 1), tail(i)], -2).alias("left"),
                        _around([F.get("gaps", last + 1)["head"], token(last + 1), F.get("gaps", last + 2)["head"], token(last + 2)],
                                2).alias("right"))

    tokens = F.filter(F.transform("found", seeded), lambda t: (t.kind.isNotNull() | ~t.touched) & ((t.left != "") | (t.right != "")))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("digest"), "base", F.coalesce(tokens, F.array().cast(
        "array<struct<start:int,token:string,kind:string,seed:string,touched:boolean,left:string,right:string>>")).alias("tokens"))
    return staged(rows, "personal")


def _patterns(left: Column, right: Column) -> Column:
    """The patterns of an occurrence: side and words, one or two of them."""
    def of(side: str, words: Column, nearest: int) -> list[Column]:
        one = F.substring_index(words, " ", nearest)
        return [F.when(one != "", F.struct(F.lit(side).alias("side"), one.alias("words"))),
                F.when(one != words, F.struct(F.lit(side).alias("side"), words.alias("words")))]

    return F.filter(F.array(*of("left", left, -1), *of("right", right, 1)), lambda pattern: pattern.isNotNull())


def occurring(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """side, words, total: how often the words occur in the corpus with anything on the side where the token would be."""
    texts = pick(docs, "text").select(F.split(_context(text_or_empty()), " ").alias("all"))
    ends = F.size("all")
    one = F.transform("all", lambda word, i: F.struct(word.alias("words"), (i + 1 < ends).alias("left"), (i > 0).alias("right")))
    two = F.transform(F.slice("all", 1, F.greatest(ends - 1, F.lit(0))), lambda word, i: F.struct(
        F.concat(word, F.lit(" "), F.get("all", i + 1)).alias("words"), (i + 2 < ends).alias("left"), (i > 0).alias("right")))
    each = texts.select(F.explode(one).alias("w")).unionByName(texts.select(F.explode(two).alias("w"))).select("w.*")
    # Patterns are few beside the pairs of words of a corpus: pairs that are none go before they are moved.
    wanted = each.join(patterns.select("words").distinct(), "words", "left_semi")
    counted = wanted.groupBy("words").agg(F.sum(F.col("left").cast("long")).alias("left"), F.sum(F.col("right").cast("long")).alias("right"))
    return patterns.select("side", "words").distinct().join(counted.hint("merge"), "words").select(
        "side", "words", F.when(F.col("side") == "left", F.col("left")).otherwise(F.col("right")).alias("total"))


def discovered(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """uid, kind, start, end of identifiers that confident patterns point to and no base span touches."""
    each = rows.where(F.size("tokens") > 0).select("uid", F.explode("tokens").alias("t")).select("uid", "t.*")
    lead = F.length(F.regexp_extract("token", r"^[^A-Za-z0-9+]*+", 0))
    core = F.regexp_replace(F.regexp_replace("token", r"^[^A-Za-z0-9+]++", ""), r"[^A-Za-z0-9]++$", "")
    each = each.select("uid", (F.col("start") + lead).alias("start"), F.coalesce("seed", core).alias("instance"),
                       F.explode(_patterns(F.col("left"), F.col("right"))).alias("p"), "kind").where("instance <> ''")
    each = staged(each.select("uid", "start", "instance", "p.side", "p.words", "kind"), "occurrences")
    nothing = each.select("uid", "kind", "start", F.col("start").alias("end")).limit(0)
    if each.where("kind is null").isEmpty() or each.where("kind is not null").isEmpty():
        return nothing
    kinds = F.array(*[F.when(F.col("kind").eqNullSafe(kind) | F.col("kind").isNull() & F.col("instance").rlike(look), F.lit(kind))
                      for kind, look in LOOKS.items()])
    edges = staged(each.groupBy("side", "words", "instance", "kind").agg(F.count(F.lit(1)).alias("n")).select(
        "*", F.explode(F.filter(kinds, lambda kind: kind.isNotNull())).alias("as_kind")), "graph")
    # Whatever is believed later, a pattern needs so many instances that may be of the kind, and a seed or believed one.
    able = staged(edges.groupBy("side", "words", "as_kind").agg(F.count(F.lit(1)).alias("instances")).where(
        F.col("instances") >= SUPPORT).drop("instances"), "patterns")
    if able.isEmpty():
        return nothing
    totals = staged(able.join(occurring(docs, able).hint("merge"), ["side", "words"]), "totals")
    pattern = ["side", "words", "as_kind"]
    seeds = edges.where("kind is not null").select("instance", "as_kind").distinct()
    edges = staged(edges.join(totals.hint("merge"), pattern), "edges")
    believed, found, before = staged(seeds, "seeds"), None, 0
    while True:
        known = edges.join(believed.withColumn("known", F.lit(True)).hint("merge"), ["instance", "as_kind"], "left") \
            .withColumn("known", F.coalesce("known", F.lit(False)))
        # What is believed only grows, and with it the confidence of patterns: the loop ends when nothing is added.
        scored = known.groupBy(pattern).agg(
            F.count(F.when(F.col("known"), 1)).alias("support"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("matches"),
            F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("open"), F.first("total").alias("total"))
        sure = scored.withColumn("sure", F.col("matches") / (F.col("total") - F.col("open") + SMOOTHING)).where(
            (F.col("support") >= SUPPORT) & (F.col("sure") >= PATTERN_CONFIDENCE))
        sure = staged(sure.select(*pattern, "sure"), "sure")
        told = edges.where("kind is null").join(sure.hint("merge"), pattern)
        found = staged(told.groupBy("instance", "as_kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("sure", F.lit(0.999)))))).alias("belief")).where(F.col("belief") >= INSTANCE_CONFIDENCE), "beliefs")
        added = found.count()
        if added == before:
            break
        before = added
        believed = seeds.unionByName(found.select("instance", "as_kind")).distinct()
    if not before:
        return nothing
    # An instance belongs to the kind it is surest of; it counts wherever one of the sure patterns stands beside it.
    best = found.groupBy("instance").agg(F.max(F.struct("belief", "as_kind")).alias("best")).select(
        F.col("instance"), F.col("best.as_kind").alias("as_kind"))
    fresh = each.where("kind is null").drop("kind").join(best.hint("merge"), "instance").join(sure.select(*pattern).hint("merge"), pattern)
    return fresh.select("uid", F.col("as_kind").alias("kind"), "start", (F.col("start") + F.length("instance")).alias("end")).distinct()


def _in_order(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(kinds, s.kind).alias("rank"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (spans of the exact patterns), spans (those and the added ones).

    Spans are (kind, start, end) in code points, end exclusive, by kind as in KINDS and then start. NULL and empty texts
    have none. Repeated rows get the same answer each; no rows give no rows; other columns are ignored, whatever their
    names.
    """
    rows = scanned(docs)
    added = staged(discovered(docs, rows), "added")
    if added.isEmpty():
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    more = added.groupBy(F.col("uid").alias("_uid")).agg(F.collect_set(F.struct(
        "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("more"))
    found = rows.join(more.hint("merge"), F.col("uid") == F.col("_uid"), "left")
    return found.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
        _in_order(F.concat("base", "more"))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as [KIND]; of overlapping spans the first in the text counts, and the rest goes with it."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("back"), s.kind.alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(order, start, lambda acc, s: F.struct(
        F.greatest(acc.at, -s.back).alias("at"),
        F.when(s.start >= acc.at, F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit("["), F.upper(s.kind), F.lit("]")))
        .otherwise(acc.out).alias("out")))
    return F.when(F.size(spans) > 0, F.concat(folded.out, F.substring(text, folded.at + 1, F.length(text)))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, where there is one, counted again."""
    rows = scanned(docs)
    added = staged(discovered(docs, rows), "added")
    place = docs.columns.index("text")
    table = positional(docs)
    text = F.col(f"_{place}").cast("string")
    spans = F.coalesce(base_spans(text), F.array().cast(SPAN))
    if not added.isEmpty():
        key = docs.columns.index("doc_id")
        kind = table.schema[key].dataType.simpleString()
        # Rows of one doc_id may have different texts: spans go to the text that they were found in.
        places = rows.select("uid", F.col("doc_id").cast(kind).alias("_id"), F.col("digest").alias("_digest"))
        by_id = added.join(places.hint("merge"), "uid").groupBy("_id", "_digest").agg(
            F.collect_set(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("_more"))
        table = table.join(by_id.hint("merge"), F.col(f"_{key}").eqNullSafe(F.col("_id")) & (
            F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_digest")), "left")
        spans = F.concat(spans, F.coalesce("_more", F.array().cast(SPAN)))
    made = table.withColumn("_spans", spans).withColumn("_text", redacted(text, F.col("_spans")))
    columns = [F.col("_text") if i == place else
               F.when(text.isNull(), F.col(f"_{i}")).otherwise(F.length("_text").cast(docs.schema[i].dataType))
               if name == "n_chars" else F.col(f"_{i}") for i, name in enumerate(docs.columns)]
    return made.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).toDF(*docs.columns)
