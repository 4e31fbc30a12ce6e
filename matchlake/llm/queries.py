"""The queries of the operators: opN_<name>(spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.brown import class_scores
from matchlake.llm.collocations import collocations
from matchlake.llm.common import table
from matchlake.llm.decontaminate import contaminated
from matchlake.llm.fim import fill_in_middle, restored
from matchlake.llm.lines import drop_frequent_lines
from matchlake.llm.media import read_media, to_media
from matchlake.llm.packing import pack, word_lengths
from matchlake.llm.pii import digest, personal_data
from matchlake.llm.quality import quality_scores
from matchlake.llm.simhash import simhash_classes
from matchlake.llm.substring import drop_repeats
from matchlake.llm.tokens import token_counts
from matchlake.llm.warc import archived


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files of public tokenizers lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), shingle=4, most=4)


def op3_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))


def op6_token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op8_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(to_media(table(spark, sf_dir, "documents")))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(table(spark, sf_dir, "documents")))


def op11_era_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, most=2000)


def op12_fim_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored_text").alias("restored_sha256"))


def op13_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_qgram_bands, op2_simhash_pivots, op3_pii_votes, op4_line_runs, op5_brown_classes, op6_token_prefixes, op7_warc_salvage, op8_png_media, op9_pu_quality, op10_variable_best_fit, op11_era_collocations, op12_fim_sparse_index, op13_fm_substrings)}

SQL = {
    "op11_era_collocations": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), own AS (
            SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w FROM piece
        ), total AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM own GROUP BY lang
        ), place AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM own
        ), size AS (
            SELECT lang, w, p, unnest(range(1, least(4, len(w) - p + 1) + 1)) AS d FROM place
        ), number AS MATERIALIZED (
            SELECT lang, d AS words, array_to_string(w[p : p + d - 1], ' ') AS phrase, count(*) AS f FROM size GROUP BY ALL HAVING count(*) >= 30
        ), candidate AS MATERIALIZED (
            SELECT *, string_split(phrase, ' ') AS w FROM number WHERE words > 1
        ), cut AS (
            SELECT lang, phrase, w, f AS a, unnest(range(1, words)) AS k FROM candidate
        ), half AS (
            SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS one, array_to_string(w[k + 1 :], ' ') AS two FROM cut
        ), scored AS (
            SELECT h.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
            FROM half h JOIN number x ON x.lang = h.lang AND x.phrase = h.one JOIN number y ON y.lang = h.lang AND y.phrase = h.two
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), begin AS (
            SELECT lang, w, words, f, unnest(range(1, words)) AS i FROM candidate
        ), stop AS (
            SELECT *, unnest(range(i + 1, words + 1)) AS j FROM begin
        ), around AS (
            SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(f) AS f FROM stop WHERE j - i + 1 < words GROUP BY ALL
        ), ranked AS (
            SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
            FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 80 * b.a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_fm_substrings": r"""
        WITH own AS (
            SELECT doc_id, row_number() OVER () AS doc_row, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w
            FROM documents
        ), start AS (
            SELECT doc_id, doc_row, unnest(range(1, len(w) - 11)) AS p FROM own
        ), win AS (
            SELECT s.doc_id, s.doc_row, s.p, array_to_string(o.w[s.p : s.p + 12], ' ') AS words FROM start s JOIN own o USING (doc_row)
        ), least AS (
            SELECT *, min(doc_id) OVER (PARTITION BY words) AS first_id FROM win
        ), gone AS (
            SELECT DISTINCT doc_row, unnest(range(p, p + 13)) AS p FROM least WHERE first_id < doc_id
        ), word AS (
            SELECT doc_row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM own
        ), kept AS (
            SELECT w.doc_row, count(*) AS n_kept, string_agg(w.word, ' ' ORDER BY w.p) AS kept
            FROM word w LEFT JOIN gone g ON w.doc_row = g.doc_row AND w.p = g.p WHERE g.p IS NULL GROUP BY w.doc_row
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n_kept, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM own LEFT JOIN kept USING (doc_row)""",
    "op12_fim_sparse_index": """
        WITH own AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
        ), h AS (
            SELECT doc_id, text, length(text) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
                ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM own
        ), cut AS (
            SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), part AS (
            SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM cut
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM part""",
    "op7_warc_salvage": """
        WITH page AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), first AS (
            SELECT payload_digest, min(page_id) AS first_id FROM page WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, p.payload_digest,
            CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first_id THEN first_id END AS refers_to, 0::BIGINT AS gap_bytes
        FROM page p LEFT JOIN first f ON p.payload_digest = f.payload_digest""",
    "op4_line_runs": r"""
        WITH cut AS (
            SELECT doc_id, row_number() OVER () AS doc_row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), line AS (
            SELECT doc_id, doc_row, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM cut
        ), keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
        ), frequent AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_row) >= 10
        ), marked AS (
            SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_row""",
}
