"""Queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.session import prepare
from outflow.llm.class_lm import score_texts
from outflow.llm.conversation_repair import damage, repair_parts, report
from outflow.llm.cotraining import classify
from outflow.llm.hash_tree import grown, place, uniform
from outflow.llm.imatch import fingerprints
from outflow.llm.mixing import mix
from outflow.llm.ngram_join import link_classes
from outflow.llm.permutation_index import search
from outflow.llm.pieces import decode, encode
from outflow.llm.substring_dedup import remove_repeats
from outflow.llm.url_filter import judge_urls
from outflow.llm.vector_codes import compress
from outflow.llm.wordpiece import count_tokens


def ready(spark: SparkSession) -> SparkSession:
    """Settings the results depend on; Python workers of a local session find the package where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return prepare(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return docs.select("doc_id", "text_score", "meta_score", "score", "keep")


def op6_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every text, and the digest of the text decoded from them."""
    coded = encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    back = decode(coded).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "decoded_sha256")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return link_classes(table(spark, folder, "documents"))


def op9_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "ranges")


def op11_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards, two to a rack and two racks to a region; the seventeenth comes as a region of its own."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = place(docs, uniform(16), order=("doc_id", "size", "text_crc32"), after=grown(uniform(16)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    rows = table(spark, folder, "conversations")
    known = rows.select(F.col("conv_id").alias("id")).distinct()
    done = report(*repair_parts(damage(rows)))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded = compress(table(spark, folder, "embeddings"))
    return coded.rows.withColumn("codebooks_sha256", F.lit(coded.codebooks_sha256()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_counts": op4_token_counts,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_permutation_index": op6_permutation_index,
    "op7_ngram_join": op7_ngram_join,
    "op8_url_filters": op8_url_filters,
    "op9_class_lm": op9_class_lm,
    "op10_mixing": op10_mixing,
    "op11_hash_tree": op11_hash_tree,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

def _bytes_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"


# The table of the CRC-32 polynomial, and the checksum of a text by it.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"""


def crc_sql(text: str) -> str:
    """For a query that has ``crc_table`` in reach."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_bytes_sql(text)}), "
        "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT"
    )


def _hash_tree_sql() -> str:
    draw = lambda path, weight: (
        f"-ln((('0x' || substr(md5({path} || ':' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {weight}"
    )
    least = lambda prefix, n, weight: (
        f"list_min(list_transform(range({n}), lambda i: {{'d': {draw(f'{prefix} || i', weight)}, 'c': i}})).c"
    )
    regions = "list_transform(range(5), lambda i: {'d': " + draw("'11/' || i", "(CASE WHEN i = 4 THEN 1.0 ELSE 4.0 END)") + ", 'c': i})"
    return f"""
        WITH t AS ({CRC_TABLE_SQL}),
        d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
                     coalesce('+' || doc_id, '-null') AS k FROM documents, t),
        r AS (SELECT *, {least("'11/'", 4, "4.0")} AS region, list_min({regions}).c AS grown_region FROM d),
        q AS (SELECT *, {least("'11/' || region || '/'", 2, "2.0")} AS rack FROM r),
        s AS (SELECT *, list_min(list_transform(range(2), lambda i: {{'d': {draw("'11/' || region || '/' || rack || '/' || (4 * region + 2 * rack + i)", "1.0")},
                     'c': (4 * region + 2 * rack + i)}})).c AS shard FROM q)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
               (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot,
               (CASE WHEN grown_region = 4 THEN 16 ELSE shard END)::INTEGER AS grown_shard
        FROM s"""


def _conversation_repair_sql() -> str:
    """A fold over each conversation's rows that keeps the least ``cost || audit`` for each state of the grammar.

    Its elements are the rows and, before, between and behind them, a chance to insert one message.
    """
    add = lambda x, cost, letter: f"lpad((left({x}, 6)::INTEGER + {cost})::VARCHAR, 6, '0') || substr({x}, 7) || '{letter}'"
    q = ["a[1]", "a[2]", "a[3]", "a[4]"]
    inserted = [q[0], q[1], "least(" + ", ".join([q[2], *(add(q[i], 5, "I") for i in (0, 1, 3))]) + ")", f"least({q[3]}, {add(q[2], 5, 'I')})"]
    extra = "(CASE r[2] WHEN 't' THEN 5 ELSE 0 END)"
    kept = lambda initial, states: [f"CASE WHEN r[1] = '{initial}' AND r[2] <> 'x' THEN {add(q[i], extra, 'K')} END" for i in states]
    changed = lambda states: [f"CASE WHEN r[2] <> 'x' THEN {add(q[i], f'1 + {extra}', 'R')} END" for i in states]
    gone = [add(x, 2, "D") for x in q]
    taken = [
        gone[0], "least(" + ", ".join([gone[1], *kept("s", [0])]) + ")", "least(" + ", ".join([gone[2], *kept("u", [0, 1, 3]), *changed([0, 1, 3])]) + ")",
        "least(" + ", ".join([gone[3], *kept("a", [2]), *changed([2])]) + ")",
    ]
    return rf"""
        WITH t AS ({CRC_TABLE_SQL}),
        o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations, t),
        d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                     CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE hit <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c,
                     regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS z FROM d),
        f AS (SELECT *, CASE WHEN z = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM n),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (i > 1 AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal,
                     list([c, CASE fault WHEN 'truncated' THEN 't' WHEN '' THEN 'f' ELSE 'x' END] ORDER BY i) AS rows FROM f GROUP BY conv_id),
        e AS (SELECT * EXCLUDE (rows), list_reduce(
                  list_concat([['000000', NULL, NULL, NULL]], flatten(list_transform(rows, lambda r: [['', 'i'], r])), [['', 'i']]),
                  lambda a, r: CASE WHEN r[2] = 'i' THEN [{", ".join(inserted)}] ELSE [{", ".join(taken)}] END) AS a FROM g),
        b AS (SELECT * EXCLUDE (a), left(least(a[1], a[4]), 6)::BIGINT AS cost, substr(least(a[1], a[4]), 7) AS audit FROM e),
        u AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS j, audit FROM b),
        v AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, sum(CASE WHEN substr(audit, j, 1) = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM u),
        w AS (SELECT v.conv_id, j, edit, f.role, f.text, row_number() OVER (PARTITION BY v.conv_id ORDER BY j) AS k,
                     first_value(CASE WHEN edit = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY v.conv_id ORDER BY j) AS led
              FROM v LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i WHERE edit <> 'D'),
        said AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role || ':' || text
                     ELSE CASE WHEN (k - led) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END END, chr(10) ORDER BY j) AS said
                 FROM w GROUP BY conv_id)
        SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(said, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM k.conv_id
        LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM k.conv_id"""


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (SELECT vec_id, label, x.p, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d, x.v
              FROM parts x JOIN b{i} b ON x.p = b.p),
        a{i} AS (SELECT vec_id, label, p, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(v) AS v FROM d{i} GROUP BY vec_id, label, p),
        m{i} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS v
              FROM (SELECT p, e, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e),
        b{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e),""")
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p)),
        b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {entries}),{"".join(steps)}
        text AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
        rows AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM rows, text"""


SQL: dict[str, str] = {
    "op12_conversation_repair": _conversation_repair_sql(),
    "op13_vector_codes": _vector_codes_sql(),
    "op11_hash_tree": _hash_tree_sql(),
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS s, words FROM w WHERE len(words) >= 20),
        keyed AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS k FROM win),
        late AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late WHERE r > 1),
        kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept, count(*) AS n
                 FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) e
                 ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words FROM documents),
        sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                   ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
        FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
}
