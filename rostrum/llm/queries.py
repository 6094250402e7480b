"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import bpe, exact_dedup, html_text, license, merkle, minhash, packing, quality, resample, rules, secrets, shared, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers are; another path can be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition, vocabulary = packing.read_definition(tokenizer_path("word_bpe_49k.json"))
    return packing.pack(_table(spark, sf_dir, "documents"), definition, vocabulary)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    detector = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), detector)
    return scored.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.Ranks.read(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(_table(spark, sf_dir, "documents"), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    order, _ = shared.stage(simhash.order_of(docs), "simhash-next")
    texts = simhash.with_next(docs, order)
    edited = simhash.edited(F.col("text"), F.col("head"))
    key = ["id", "hash", "edited_sha256"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), edited.alias("text"))))
    both = texts.select("id", "hash", F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), sides.alias("s"))
    prints = simhash.fingerprints(both.select(*key, "s.side", "s.text"), [*key, "side"])
    of = lambda side, x: F.max(F.when(F.col("side") == side, F.col(x)))
    each = prints.groupBy(*key).agg(of(0, "hi").alias("hi"), of(0, "lo").alias("lo"), of(1, "hi").alias("edited_hi"), of(1, "lo").alias("edited_lo"))
    rows, _ = shared.stage(each.join(order, ["id", "hash"]), "simhash-prints")
    following = rows.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("hi").alias("next_hi"), F.col("lo").alias("next_lo"))
    # searches: every id divisible by 20, against all fingerprints
    found = simhash.within(rows.select("hi", "lo", F.explode(F.sequence(F.lit(1), "repeats"))), rows.filter("doc_id % 20 = 0").select("hi", "lo"))
    hits = found.groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).agg((F.sum("b_rows") - 1).alias("others"), F.max(F.when(F.col("distance") == 0, F.col("b_rows"))).alias("n"))
    hits, _ = shared.stage(hits, "simhash-hits")
    out = shared.join_counted(rows.join(following, ["next_id", "next_hash"]), hits, ["hi", "lo"], rows.count())
    own, edit, ahead = ([F.col(f"{side}hi"), F.col(f"{side}lo")] for side in ("", "edited_", "next_"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "repeats"))).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.hexadecimal(own).alias("fingerprint"),
        simhash.hexadecimal(edit).alias("edited_fingerprint"),
        simhash.likeness(own, edit).alias("near_edited"),
        simhash.likeness(own, ahead).alias("near_next"),
        F.when(F.col("doc_id") % 20 == 0, F.col("others")).alias("n_within"),
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents")).drop("text_hash")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), ranker)
    return scored.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda no: F.size(F.filter("hits", lambda h: h["no"] == no)).cast("long")
    base = F.filter("hits", lambda h: h["no"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("hits")).alias("spans"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = {f: docs[f] for f in merkle.FIELDS}
    bare = merkle.leaf(fields | {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))})
    tampered = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, bare)
    found = merkle.proofs(merkle.build(docs, claimed=tampered), whole=False)
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted once, for the forest and for the judgement
    counts, _ = shared.stage(rules.measure(_table(spark, sf_dir, "documents")), "rules-counts")
    return rules.judge(counts, rules.fitted(counts, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_simhash": op7_simhash,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_quality_rules": op13_quality_rules,
}



def _secret_sql() -> str:
    """The spans in DuckDB: gaps between matches and matches, added up."""

    def spans(rule: secrets.Rule, no: int) -> str:
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        size = lambda what, to: f"coalesce(list_sum(list_transform({what}[1:{to}], lambda x: length(x))), 0)"
        gaps, found, group = (f"string_split_regex(t, {pattern})", f"regexp_extract_all(t, {pattern}, 0)", f"regexp_extract_all(t, {pattern}, {rule.group})")
        one = f"{{'s': ({size('g', 'i')} + {size('m', 'i - 1')})::BIGINT, 'no': {no}, 'e': ({size('g', 'i')} + {size('m', 'i')})::BIGINT, 'n': length(k[i])}}"
        return (
            f"SELECT doc_id, row, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {one}), lambda h: h.n >= {max(rule.least, 1)})) AS h "
            f"FROM (SELECT doc_id, row, {gaps} AS g, {found} AS m, {group} AS k FROM d WHERE regexp_matches(t, {pattern}))"
        )

    names = "[" + ", ".join(f"'{r.name}'" for r in secrets.RULES) + "]"
    text = f"string_agg({names}[h.no + 1] || ':' || h.s || ':' || h.e, ',' ORDER BY h.s, h.no, h.e)"
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
        s AS ({" UNION ALL ".join(spans(r, i) for i, r in enumerate(secrets.RULES))}),
        a AS (SELECT row, count(*) FILTER (h.no = 0) AS a, count(*) FILTER (h.no = 1) AS b, count(*) FILTER (h.no = 2) AS c,
                     {text} FILTER (h.no < 3) AS base, {text} AS spans FROM s GROUP BY row)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)
    """


#: CRC-32 in DuckDB: the table of its 256 remainders by rule, and the sum over the bytes of a string.
_CRC_TABLE = """
    crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS tab)"""


def _crc(of: str) -> str:
    """The unsigned CRC-32 of a string column, where the one row of crc is joined."""
    code = f"hex(encode({of}))"
    octets = f"list_transform(range(length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295))"


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    climb = lambda at: f"""
        UNION ALL SELECT t, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {at} WHERE n > 1 GROUP BY t, lvl, i // 3, n"""  # noqa: E731
    runs = lambda of: f"(SELECT t, lvl, i // 3 AS j, string_agg(h, '' ORDER BY i) AS s FROM {of} WHERE n > 1 GROUP BY t, lvl, i // 3)"
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t
          FROM (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf("replace(text, chr(10), '')")} AS bare, {_crc('doc_id::VARCHAR')} % 2 = 0 AS tampered FROM documents, crc)),
        up(t, lvl, i, n, h) AS (SELECT t, 0, i, n, leaf FROM leaves{climb('up')}),
        subroots AS (SELECT t, h FROM up WHERE n = 1),
        top(t, lvl, i, n, h) AS (SELECT 0, 0, t, (SELECT count(*) FROM subroots), h FROM subroots{climb('top')}),
        runs AS (SELECT t, lvl, j, s FROM {runs('up')}),
        outers AS (SELECT lvl, j, s FROM {runs('top')}),
        fold(doc_id, leaf, t, lvl, i, f, proof) AS (
          SELECT doc_id, leaf, t, 0, i, CASE WHEN tampered THEN bare ELSE leaf END, '' FROM leaves
          UNION ALL
          SELECT doc_id, leaf, fold.t, fold.lvl + 1, i // 3, sha256(substr(s, 1, (i % 3) * 64) || f || substr(s, (i % 3) * 64 + 65)), proof || substr(s, 1, (i % 3) * 64) || substr(s, (i % 3) * 64 + 65)
          FROM fold JOIN runs ON runs.t = fold.t AND runs.lvl = fold.lvl AND runs.j = fold.i // 3),
        below AS (SELECT doc_id, leaf, t, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof FROM fold GROUP BY doc_id, leaf, t),
        above(doc_id, leaf, t, lvl, i, f, proof) AS (
          SELECT doc_id, leaf, t, 0, t, f, proof FROM below
          UNION ALL
          SELECT doc_id, leaf, t, above.lvl + 1, i // 3, sha256(substr(s, 1, (i % 3) * 64) || f || substr(s, (i % 3) * 64 + 65)), proof || substr(s, 1, (i % 3) * 64) || substr(s, (i % 3) * 64 + 65)
          FROM above JOIN outers ON outers.lvl = above.lvl AND outers.j = above.i // 3),
        ends AS (SELECT doc_id, leaf, t, arg_max(f, lvl) AS f, arg_max(proof, lvl) AS proof FROM above GROUP BY doc_id, leaf, t)
        SELECT doc_id, leaf, subroots.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
        FROM ends JOIN subroots USING (t), (SELECT h FROM top WHERE n = 1) AS root
    """


def _resample_sql() -> str:
    words = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
        buckets AS (SELECT word, {_crc('word')} % {resample.BUCKETS} AS bucket FROM (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM b)), crc),
        own AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN buckets USING (word) GROUP BY 1, 2),
        s AS (SELECT bucket, sum(n) AS s FROM own GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN buckets USING (word) GROUP BY 1),
        totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS a, (SELECT coalesce(sum(t), 0) FROM t) AS z),
        gains AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * (a + {resample.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (z + {resample.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
        sums AS (SELECT doc_id, sum(n * gain)::BIGINT AS total FROM own JOIN gains USING (bucket) GROUP BY 1),
        weights AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight FROM d LEFT JOIN sums USING (doc_id)),
        scores AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('{resample.SEED}:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weights),
        ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scores WHERE n >= {resample.LEAST_WORDS})
        SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= {resample.PERCENT} * able // 100 THEN rank END AS rank
        FROM scores LEFT JOIN ranks USING (doc_id)
    """


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_FOLD} AS t FROM documents) WINDOW w AS (PARTITION BY t)
    """,
    "op10_secret_scan": _secret_sql(),
    "op11_merkle_manifest": _merkle_sql(),
    "op12_importance_resampling": _resample_sql(),
}
