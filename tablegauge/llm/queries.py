"""Registered queries of the operators, each over its whole table, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import (
    chat,
    collocations,
    exact_dedup,
    html_text,
    licenses,
    near_dedup,
    packing,
    pieces,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
)
from tablegauge.llm.shared import pick, piece_model, read_table, word_vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for it, by Golomb-coded fingerprint exchange."""
    return exact_dedup.find_copies(read_table(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 4096 ids."""
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), word_vocabulary())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


NEAR = near_dedup.Settings(words=2, percent=80)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among links of two-word shingles with a similarity of 0.8 or more."""
    return near_dedup.link(read_table(spark, sf_dir, "documents"), NEAR)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the voting rules."""
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "posterior")


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by weighted rules over its statistics."""
    return quality_classifier.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.shard(read_table(spark, sf_dir, "documents"), 40)


def op7_aligned_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, of the text they decode to and of the byte spans of all pieces."""
    return pieces.digests(read_table(spark, sf_dir, "documents"), piece_model())


def op8_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of what is trained on, read back from its windows."""
    said = "\\### Assistant: </turn> ok"
    turns = pick(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                                                    F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    probe = probe.select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role",
                         F.lit(said).alias("text"))
    made = chat.windows(turns.unionByName(probe))
    lines = F.transform(chat.read_turns(F.col("text"), F.col("n_repeated")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    read = made.select("conv_id", "window", F.size(lines).alias("turns"), F.array_join(lines, "").alias("said"),
                       F.array_join(chat.read_targets(F.col("text"), F.col("loss")), "").alias("trained"),
                       F.length("text").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.sum("turns").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "trained"))).alias("parts"))
    said_all, trained = (F.array_join(F.transform("parts", f), "") for f in (lambda p: p.said, lambda p: p.trained))
    return whole.select("conv_id", "n_turns", F.sha2(said_all, 256).alias("turns_sha256"),
                        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
                        "formatted_chars")


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the exact patterns, and all spans."""
    found = pii.find(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda span: span.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.written_spans(F.col("base")), 256).alias("base_sha256"),
                        pii.written_spans(F.col("spans")).alias("spans"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest collocations of every language."""
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the license phrases in every document, and the labels of all notices in it."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda place: place.exact)
    starts = F.transform(base, lambda place: place.start)

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda place: place.label))), ",")

    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("found", lambda place: place.share)), F.lit(0.0)).alias("score"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations with shared heads."""
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_template_removal": op5_template_removal,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_aligned_pieces": op7_aligned_pieces,
    "op8_budgeted_windows": op8_budgeted_windows,
    "op9_contextual_pii": op9_contextual_pii,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_license_scan": op12_license_scan,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op10_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
             g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
        from t join g using (norm)""",
    "op11_phrase_collocations": r"""
        with pieces as (
          select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
          from documents),
        words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
        total as (select lang, sum(len(w))::bigint as n from words group by lang),
        lead as (
          select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, w[i + 3] as w4, w[i + 4] as w5
          from (select lang, w, unnest(range(1, len(w) + 1)) as i from words) t),
        f as (
          select lang, 1 as m, w1 as p, count(*) as a from lead group by lang, w1 having count(*) >= 100
          union all select lang, 2, concat_ws(' ', w1, w2), count(*) from lead where w2 is not null group by lang, w1, w2 having count(*) >= 100
          union all select lang, 3, concat_ws(' ', w1, w2, w3), count(*) from lead where w3 is not null group by lang, w1, w2, w3 having count(*) >= 100
          union all select lang, 4, concat_ws(' ', w1, w2, w3, w4), count(*) from lead where w4 is not null
            group by lang, w1, w2, w3, w4 having count(*) >= 100
          union all select lang, 5, concat_ws(' ', w1, w2, w3, w4, w5), count(*) from lead where w5 is not null
            group by lang, w1, w2, w3, w4, w5 having count(*) >= 100),
        inside as (
          select lang, array_to_string(string_split(p, ' ')[i : i + k - 1], ' ') as p, max(a) as around
          from f, range(1, 5) as s(i), range(2, 5) as t(k) where k < m and i + k - 1 <= m group by all),
        cut as (
          select lang, p, a, m, unnest(range(1, m)) as k from f left join inside using (lang, p)
          where m > 1 and coalesce(100 * around < 100 * a, true)),
        scored as (
          select lang, c.p as phrase, c.a, l.a as l, r.a as r, n, k, (1000::hugeint * c.a * n) // (l.a::hugeint * r.a) as score
          from (select *, array_to_string(string_split(p, ' ')[1 : k], ' ') as head, array_to_string(string_split(p, ' ')[k + 1 :], ' ') as rest
                from cut) c
            join (select lang, p as head, a from f) l using (lang, head) join (select lang, p as rest, a from f) r using (lang, rest)
            join total using (lang)),
        lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
        from lowest qualify rank <= 2000""",
    "op13_conversation_trie": r"""
        with t as (
          select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
            struct_pack(role := coalesce(role, ''), said := coalesce(text, '')) as turn
          from conversations where conv_id is not null),
        own as (select conv_id, list(turn order by i) as turns from t group by conv_id),
        c as (
          select *, xor(list_reduce(
              flatten(list_transform(string_split(conv_id::varchar, ''), lambda d: [ascii(d)::bigint] || [-1::bigint for _ in range(8)])),
              lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, 3988292384 * (x & 1)) end, 4294967295::bigint), 4294967295) % 6 as h
          from own),
        rebuilt as (
          select c.conv_id, list_concat(coalesce(b.turns, [])[1 : c.h], c.turns[c.h + 1 :]) as turns
          from c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
        member as (
          select conv_id, depth, turns[1 : depth] as path, len(turns) = depth as ended
          from rebuilt, unnest(range(0, len(turns) + 1)) as d(depth)),
        node as (
          select path, depth, min(conv_id) as conv_id, count(*) as n_convs,
            sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ended), '')) as ends_sha256,
            case when depth > 0 then (count(*) - 1) * length(path[depth].said) else 0 end as saved
          from member group by path, depth),
        child as (
          select n.*, (select count(*) from node k where k.depth = n.depth + 1 and k.path[1 : n.depth] = n.path) as n_children from node n),
        below as (
          select path[1 : up] as path, up as depth, sum(saved) as saved_tokens, count(*) filter (n_children = 0) as n_leaves
          from child, unnest(range(0, depth + 1)) as u(up) group by 1, 2)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::bigint as saved_tokens,
          n.ends_sha256
        from child n join below using (path, depth) left join node p on p.depth = n.depth - 1 and p.path = n.path[1 : p.depth]""",
}
