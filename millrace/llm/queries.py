"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import compression, cross_polytope, divergence, line_dedup, minhash, mixing, ngram_lm, nn_descent, ordinal, packing, phrases, ppm, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(tables: str, oracle: str | None = None):
    """Register ``fn(*tables) -> DataFrame`` under its own name; ``tables`` are their names."""

    def wrap(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables.split()])
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return wrap


@query(
    "documents",
    """
    WITH RECURSIVE per AS (
        SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS chars FROM documents GROUP BY source
    ), rates AS (
        SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM per) * (SELECT sum(chars) FROM per) / chars AS rate FROM per
    ), terms AS (
        SELECT source, 0 AS k, rate, -rate AS log_p, exp(-rate) AS cdf FROM rates
        UNION ALL
        SELECT source, k + 1, rate, log_p + ln(rate / (k + 1)), cdf + exp(log_p + ln(rate / (k + 1)))
        FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 25)
    ), draws AS (
        SELECT doc_id, source, text, md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS draw FROM documents
    ), counted AS (
        SELECT doc_id, d.source, text, draw, count(*) AS n
        FROM draws d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source
        AND t.cdf <= ('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
        GROUP BY ALL
    ), copies AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
    SELECT doc_id, source, text, copy, ('0x' || substr(md5(draw || '|' || copy), 1, 15))::BIGINT AS shuffle_key FROM copies
    """,
)
def op2_mix_sources(documents):
    return mixing.mix_report(documents)


@query(
    "documents",
    """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), held AS (
        SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
    FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id
    """,
)
def op8_line_dedup(documents):
    return line_dedup.line_report(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("documents")
def op10_compression_bands(documents):
    return compression.quality_report(documents)


@query("documents")
def op1_minhash_near_dedup(documents):
    return minhash.duplicate_report(documents, minhash.Likeness(words=3, num=85))


@query("documents")
def op9_ppm_language(documents):
    return ppm.language_report(documents)


@query("documents")
def op6_backoff_automaton(documents):
    return ngram_lm.score(documents)


@query(
    "documents",
    """
    WITH words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
    ), windows AS (
        SELECT doc_id, pos, array_to_string(list_slice(ws, pos, pos + 12), ' ') AS win
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS pos FROM words WHERE len(ws) >= 13)
    ), firsts AS (
        SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN firsts USING (win) WHERE first < doc_id
    ), each AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words),
    kept AS (
        SELECT each.doc_id, count(gone.pos) AS n_removed, string_agg(w, ' ' ORDER BY each.pos) FILTER (gone.pos IS NULL) AS text
        FROM each LEFT JOIN gone USING (doc_id, pos) GROUP BY each.doc_id
    )
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)
    """,
)
def op5_suffix_tree_dedup(documents):
    return substring.substring_report(documents).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("documents")
def op3_bm25_packing(documents):
    return packing.pack(documents, with_ids=False)


@query("embeddings")
def op4_cross_polytope_dedup(embeddings):
    found = cross_polytope.near_vectors(embeddings)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query("documents labels")
def op7_ordinal_quality(documents, labels):
    return ordinal.quality_grades(documents, labels)


@query(
    "documents",
    r"""
    WITH named AS (
        SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), each AS (SELECT d, lang, source, unnest(terms) AS term FROM named),
    kept AS (SELECT lang, term, count(*) AS n FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
    sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    counts AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
    groups AS (
        SELECT g.lang, g.source, coalesce(t.total, 0) AS total, s.v, s.total AS lang_total
        FROM (SELECT DISTINCT lang, source FROM named) g LEFT JOIN totals t USING (lang, source) LEFT JOIN sizes s USING (lang)
    ), shares AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p,
               1 + 1000000000::HUGEINT * (k.n + 2) // (g.lang_total + 2 * g.v) AS q
        FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op11_divergence_audit(documents):
    return divergence.divergence(documents)


@query(
    "documents",
    r"""
    WITH pieces AS (
        SELECT row_number() OVER () AS p, lang, piece FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)
    ), words AS (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM words GROUP BY lang),
    grams AS (
        SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
        FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, range(1, 6) t(k) WHERE len(ws) >= k)
    ), freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    longer AS (SELECT lang, ' ' || phrase || ' ' AS padded, k, f FROM freq WHERE k > 2),
    ends AS (
        SELECT lang, k, f, unnest([array_to_string(string_split(phrase, ' ')[1:k-1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' '),
            array_to_string(string_split(phrase, ' ')[1:k-2], ' '), array_to_string(string_split(phrase, ' ')[2:k-1], ' '),
            array_to_string(string_split(phrase, ' ')[3:k], ' '), array_to_string(string_split(phrase, ' ')[1:k-3], ' '),
            array_to_string(string_split(phrase, ' ')[2:k-2], ' '), array_to_string(string_split(phrase, ' ')[3:k-1], ' '),
            array_to_string(string_split(phrase, ' ')[4:k], ' ')]) AS phrase
        FROM freq WHERE k > 2
    ), inside AS (SELECT lang, phrase, max(f) AS f FROM ends GROUP BY ALL),
    cuts AS (
        SELECT c.lang, c.phrase, c.f AS a, t.n, cut,
               array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[cut+1:c.k], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM freq WHERE k > 1) c JOIN totals t USING (lang)
        LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.f IS NULL OR 100 * i.f < 100 * c.f
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.n, cut, 1000::HUGEINT * c.a * c.n // (x.f::HUGEINT * y.f) AS score
        FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.first JOIN freq y ON y.lang = c.lang AND y.phrase = c.rest
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
           n::BIGINT AS n, score::BIGINT AS score
    FROM best QUALIFY rank <= 2000
    """,
)
def op13_phrase_collocations(documents):
    return phrases.collocations(documents)


@query("embeddings")
def op12_nn_descent_search(embeddings):
    return nn_descent.nearest(embeddings, embeddings.where("vec_id % 50 = 0"))
