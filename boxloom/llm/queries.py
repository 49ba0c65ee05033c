"""The registered queries of the training-data operators, and their reference SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import bagminhash, chat, collocations, decontaminate, exact_dedup, idcoder, langid, lines, merkle, packing, substrings, tokens, urlmodel
from boxloom.llm.common import table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.line_groups(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "line_no", F.col("keep_id").alias("keep_doc_id"), "keep_line", "group_size", "kept")


def op2_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_groups(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    tree = chat.chain_tree(turns)
    made = chat.format_paths(tree, chat.root_paths(tree))
    back = made.select(
        F.col("tree").alias("conv_id"), "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, folder, "documents"), keep="max")
    return out.withColumnRenamed("id", "doc_id")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = docs.select("doc_id", "text", langid.held_out().alias("held_out")).withColumn("doc_id", F.struct("doc_id", "held_out"))
    out = langid.identify(fold, langid.learn(docs))
    return out.select("id.doc_id", "id.held_out", "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.verdicts(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op8_id_files(spark: SparkSession, folder: str) -> DataFrame:
    files = idcoder.ids_file(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return idcoder.read_ids(files).withColumnRenamed("id", "doc_id")


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    out = substrings.repeated_passages(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


URL_RULES = [
    urlmodel.Rule("org", "/", "allow"),
    urlmodel.Rule("example.org", "/es/", "block"),
    urlmodel.Rule("example.org", "/en/1", "block"),
    urlmodel.Rule("com", "/fr/", "allow"),
    urlmodel.Rule("com", "/de/", "block"),
]


def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urlmodel.judge(table(spark, folder, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.when(tampered, F.translate("text", exact_dedup.UPPER, exact_dedup.LOWER)).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.proofs(merkle.build(table(spark, folder, "documents"), fields, changed={"text": lowered}))
    shown = [merkle.hex_text(c).alias(c) for c in ("leaf", "subroot", "root")]
    return out.select(
        F.col("id").alias("doc_id"), *shown, F.sha2(merkle.hex_text("siblings"), 256).alias("proof_sha256"),
        merkle.hex_text("folded_root").alias("folded_root"), "verified",
    )


def queries():
    found = {name: make for name, make in globals().items() if name.startswith("op") and callable(make)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _told(column):
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


SQL = {
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWERED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op12_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ),
        texts AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL
        ),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
        found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 30),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM found) c
            JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
            JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
        ),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_parts AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
            FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM found)) GROUP BY ALL
        ),
        kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 80 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang)
        QUALIFY rank <= 2000
    """,
    "op13_merkle": f"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(
                list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                    lambda d: list_concat([ascii(d)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        ),
        told AS (
            SELECT d.doc_id, source, {_told("d.doc_id")} || {_told("source")} || {_told("lang")} || {_told("n_chars")} AS head, text,
                   CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
            FROM documents d LEFT JOIN crc ON d.doc_id = crc.doc_id
        ),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
            FROM (SELECT doc_id, source, sha256(head || {_told("text")}) AS leaf, sha256(head || {_told("other")}) AS changed FROM told)
        ),
        nodes(level, source, idx, hash, n) AS (
            SELECT 0, source, pos, leaf, n FROM leaves
            UNION ALL
            SELECT level + 1, source, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (n + 15) // 16 FROM nodes WHERE n > 1
            GROUP BY level, source, idx // 16, n
        ),
        subroots AS (
            SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
        ),
        tops(level, idx, hash, n) AS (
            SELECT 0, idx, hash, n FROM subroots
            UNION ALL
            SELECT level + 1, idx // 16, sha256(string_agg(hash, '' ORDER BY idx)), (n + 15) // 16 FROM tops WHERE n > 1
            GROUP BY level, idx // 16, n
        ),
        lower(source, pos, level, idx, n, fold, proof) AS (
            SELECT source, pos, 0, pos, n, changed, '' FROM leaves
            UNION ALL
            SELECT c.source, c.pos, c.level + 1, c.idx // 16, (c.n + 15) // 16,
                   sha256(string_agg(CASE WHEN x.idx = c.idx THEN c.fold ELSE x.hash END, '' ORDER BY x.idx)),
                   c.proof || coalesce(string_agg(x.hash, '' ORDER BY x.idx) FILTER (WHERE x.idx <> c.idx), '')
            FROM lower c JOIN nodes x ON x.source IS NOT DISTINCT FROM c.source AND x.level = c.level AND x.idx // 16 = c.idx // 16
            WHERE c.n > 1 GROUP BY c.source, c.pos, c.level, c.idx, c.n, c.proof
        ),
        upper(source, pos, level, idx, n, fold, proof) AS (
            SELECT c.source, c.pos, 0, s.idx, s.n, c.fold, c.proof
            FROM lower c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source WHERE c.n = 1
            UNION ALL
            SELECT c.source, c.pos, c.level + 1, c.idx // 16, (c.n + 15) // 16,
                   sha256(string_agg(CASE WHEN x.idx = c.idx THEN c.fold ELSE x.hash END, '' ORDER BY x.idx)),
                   c.proof || coalesce(string_agg(x.hash, '' ORDER BY x.idx) FILTER (WHERE x.idx <> c.idx), '')
            FROM upper c JOIN tops x ON x.level = c.level AND x.idx // 16 = c.idx // 16
            WHERE c.n > 1 GROUP BY c.source, c.pos, c.level, c.idx, c.n, c.proof
        )
        SELECT l.doc_id, l.leaf, s.hash AS subroot, t.hash AS root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = t.hash AS verified
        FROM leaves l JOIN upper u ON u.source IS NOT DISTINCT FROM l.source AND u.pos = l.pos AND u.n = 1
        JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, (SELECT hash FROM tops WHERE n = 1) t
    """,
}


def oracle_sql():
    return dict(SQL)
