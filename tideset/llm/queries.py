"""The thin queries of the operators over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_dedup, html_text, line_dedup, merkle, near_dedup, packing, sharding, substring_dedup, toxicity, urls, whitening
from .common import LOWER, UPPER, WHITE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(toxicity.remainder("doc_id") != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_column_generation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op4_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_removed")


def line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document `op5_line_dedup` removes, which SQL can tell."""
    return op5_line_dedup(spark, sf_dir).select("doc_id", "n_removed")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.train(urls.labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")))
    read = chat.format_conversations(rows).withColumn("back", chat.parse(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of their ids, have lost their line breaks since the manifest was made."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": tampered})


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of `op12_embedding_whitening`: the vectors, their number and exact deviations."""
    return op12_embedding_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_factorization_machine_toxicity": op1_factorization_machine_toxicity,
    "op2_column_generation_packing": op2_column_generation_packing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_lookup_sharding": op4_lookup_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_substring_dedup": op13_substring_dedup,
    "line_dedup_words": line_dedup_words,
    "whitening_deviations": whitening_deviations,
}

_ITEMS = rf"""
WITH wd AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{WHITE}'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
wi AS (SELECT item_id, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{WHITE}'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS m, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS p FROM wi WHERE len(w) > 0)),
d AS (SELECT DISTINCT doc_id, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM wd, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item FROM d JOIN i USING (m, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""

_CHATS = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

#: The table of slots is filled outside of SQL (and tested against a plain version); SQL hashes the keys and places the documents.
_SHARDS = f"""
SELECT doc_id, slot, CAST(string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',')[slot + 1] AS INTEGER) AS shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) % {sharding.SLOTS} AS BIGINT) AS slot FROM documents)
"""

_REPEATS = rf"""
WITH wd AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WHITE}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS m FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM wd WHERE len(w) >= 50)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS r FROM g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS p FROM f WHERE r > 1)
SELECT doc_id, count(c.p) AS n_removed FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id
"""

_GROUPS = "SELECT a, b FROM e UNION ALL SELECT b, a FROM e"

_NEAR = rf"""
WITH RECURSIVE wd AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WHITE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + m - 1], ' ') AS s FROM (SELECT doc_id, w, least(len(w), 5) AS m, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS p FROM wd WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS ({_GROUPS}),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) USING (doc_id)
"""

_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_dot_product(p.x, q.x) >= 0.9 * sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))),
u AS ({_GROUPS}),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM u GROUP BY a) USING (vec_id)
"""

_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _tree(nodes: str, name: str) -> str:
    """CTEs from leaves (g, i, h) to {name} (g, l, i, h, s, n): the nodes of each level l, s the digests of a run, n how many nodes the level has."""
    return f"""{name}(g, l, i, h, s, n) AS (SELECT g, 0, i, h, '', count(*) OVER (PARTITION BY g) FROM {nodes}
  UNION ALL SELECT g, l, i, sha256(s), s, count(*) OVER (PARTITION BY g) FROM (SELECT g, l + 1 AS l, i // 3 AS i, string_agg(h, '' ORDER BY i) AS s FROM {name} WHERE n > 1 GROUP BY g, l, i // 3))"""


def _walk(leaves: str, tree: str, name: str) -> str:
    """CTEs from leaves (id, g, i, f, p) to {name}: the digests f and the siblings p on the way up the tree, l levels up."""
    place = "(w.j % 3)"
    before, after = f"substr(t.s, 1, 64 * {place})", f"substr(t.s, 64 * {place} + 65)"
    return f"{name}(id, g, l, j, f, p) AS (SELECT id, g, 0, i, f, p FROM {leaves} UNION ALL SELECT w.id, w.g, w.l + 1, w.j // 3, sha256({before} || w.f || {after}), w.p || {before} || {after} FROM {name} w JOIN {tree} t ON t.g = w.g AND t.l = w.l + 1 AND t.i = w.j // 3)"


_MANIFEST = f"""
WITH RECURSIVE own AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS src, source IS NULL AS none, {_leaf("text")} AS h, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS x FROM documents),
lf AS (SELECT id, doc_id, h, x, dense_rank() OVER (ORDER BY NOT none, encode(src)) - 1 AS g, row_number() OVER (PARTITION BY none, src ORDER BY doc_id NULLS FIRST, h, x) - 1 AS i FROM own),
{_tree("lf", "tr")}, sr AS (SELECT g, h FROM tr WHERE n = 1), sn AS (SELECT 0 AS g, g AS i, h FROM sr), {_tree("sn", "st")}, rt AS (SELECT h FROM st WHERE n = 1),
w0 AS (SELECT id, g, i, x AS f, '' AS p FROM lf), {_walk("w0", "tr", "wa")}, top1 AS (SELECT id, g, max_by(f, l) AS f, max_by(p, l) AS p FROM wa GROUP BY id, g),
w1 AS (SELECT id, 0 AS g, g AS i, f, p FROM top1), {_walk("w1", "st", "wb")}, top2 AS (SELECT id, max_by(f, l) AS f, max_by(p, l) AS p FROM wb GROUP BY id)
SELECT doc_id, lf.h AS leaf, sr.h AS subroot, rt.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = rt.h AS verified FROM lf JOIN sr USING (g) JOIN top2 USING (id), rt
"""

_DEVIATIONS = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) + 100000) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT r, vec_id, unnest(x) AS x, unnest(generate_series(1, len(x))) AS d FROM v), s AS (SELECT d, sum(x) AS s, count(*) AS n FROM e GROUP BY d)
SELECT vec_id, CAST(component AS INTEGER) AS component, any_value(n) AS n, CAST(sum((n * CAST(x AS HUGEINT) - s) * (n * CAST(x AS HUGEINT) - s)) AS BIGINT) AS deviation FROM e JOIN s USING (d), (SELECT unnest(generate_series(1, 8)) AS component) GROUP BY r, vec_id, component
"""

_WINDOWS = rf"""
WITH wd AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{WHITE}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS m FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS p FROM wd WHERE len(w) >= 35)),
f AS (SELECT r, p FROM g JOIN (SELECT m FROM g GROUP BY m HAVING count(*) > 1) USING (m)),
c AS (SELECT r, list(DISTINCT p + o) AS gone FROM f, (SELECT unnest(generate_series(0, 34)) AS o) GROUP BY r),
k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM wd) x WHERE NOT EXISTS (FROM (SELECT r, unnest(gone) AS p FROM c) y WHERE y.r = x.r AND y.p = x.p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM wd LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

ORACLES: dict[str, str] = {
    "line_dedup_words": _REPEATS,
    "op3_benchmark_decontamination": _ITEMS,
    "op4_lookup_sharding": _SHARDS,
    "op6_embedding_near_dedup": _VECTORS,
    "op8_minhash_near_dedup": _NEAR,
    "op10_chat_formatting": _CHATS,
    "op11_merkle_manifest": _MANIFEST,
    "op13_substring_dedup": _WINDOWS,
    "whitening_deviations": _DEVIATIONS,
}
