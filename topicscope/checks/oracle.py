"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry reads the pre-registered views (``orders``, ``lineitem``,
``documents``, ``embeddings``, ``pages``, ``labels``, ``conversations`` ...)
and returns the same columns as the Spark query of the same name.
"""

from __future__ import annotations

from ..functions.text import INLINE_MARKUP_PATTERN, TOKEN_PATTERN, english_stop_words
from ..plans import registry as R

_STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH",
         "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR"}


def _sw() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words()) + "]"


def _vec(v) -> str:
    return "CAST([" + ", ".join(repr(float(x)) for x in v) + "] AS DOUBLE[])"


OD = ("od AS (SELECT l_orderkey, CAST(MAX(l_shipdate) AS DATE) AS date_completed, "
      "CAST(MIN(l_shipdate) AS DATE) AS date_revised FROM lineitem GROUP BY l_orderkey)")
OA = ("oa AS (SELECT o_orderkey AS pmid, CAST(o_custkey % 10 AS INTEGER) AS label, "
      "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS article_date, "
      "od.date_completed, od.date_revised FROM orders LEFT JOIN od ON o_orderkey = od.l_orderkey)")
OFF = ("off AS (SELECT CAST(COALESCE(round_even(AVG(date_diff('day', article_date, date_completed)), 0), 0) AS INTEGER) "
       "AS offset_days FROM oa WHERE article_date IS NOT NULL AND date_completed IS NOT NULL)")
PRED = ("pred AS (SELECT pmid, COALESCE(article_date, CAST(date_completed - (SELECT offset_days FROM off) AS DATE)) AS date, "
        "date_completed, label FROM oa)")
BASE = f"{OD}, {OA}, {OFF}, {PRED}"


def _dpd(field: str = "date_completed") -> str:
    return (
        f"cnt AS (SELECT {field} AS date, COUNT(*) AS articles FROM oa WHERE {field} IS NOT NULL GROUP BY 1), "
        "days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date "
        "FROM (SELECT MIN(date) AS lo, MAX(date) AS hi FROM cnt)), "
        "dpd AS (SELECT days.date, COALESCE(cnt.articles, 0) AS articles FROM days LEFT JOIN cnt USING (date))"
    )


SPIKES = f"spikes AS (SELECT date FROM dpd ORDER BY articles DESC, date LIMIT {R.SPIKE_N})"


def _label_trend(src: str, unit: str, name: str = "lt") -> str:
    return (f"{name} AS (SELECT label, CAST(date_trunc('{unit}', date) AS DATE) AS date, COUNT(*) AS articles "
            f"FROM {src} WHERE date IS NOT NULL GROUP BY ALL)")


def _gap_fill(src: str, unit: str, name: str = "filled") -> str:
    return (
        f"{name}_b AS (SELECT label, MIN(date) AS lo, MAX(date) AS hi FROM {src} GROUP BY label), "
        f"{name}_s AS (SELECT label, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), {_STEP[unit]})) AS DATE) AS date FROM {name}_b), "
        f"{name} AS (SELECT s.label, s.date, COALESCE(t.articles, 0) AS articles FROM {name}_s s LEFT JOIN {src} t USING (label, date))"
    )


def _trend_matrix_ctes(labels_sql: str) -> str:
    """CTEs ending in ``tm(date, label, articles)`` for the labels in ``chosen(label)``."""
    return (
        f"{_dpd()}, {SPIKES}, chosen AS ({labels_sql}), "
        "kept AS (SELECT p.* FROM pred p WHERE p.label IN (SELECT label FROM chosen) "
        "AND NOT EXISTS (SELECT 1 FROM spikes s WHERE s.date = p.date_completed)), "
        f"{_label_trend('kept', 'month')}, {_gap_fill('lt', 'month')}, "
        "dom AS (SELECT DISTINCT date FROM filled), "
        "tm AS (SELECT dom.date, CAST(chosen.label AS INTEGER) AS label, COALESCE(f.articles, 0) AS articles "
        "FROM dom CROSS JOIN chosen LEFT JOIN filled f ON f.date = dom.date AND f.label = chosen.label)"
    )


def _fixed_labels_sql(labels) -> str:
    return " UNION ALL ".join(f"SELECT {int(x)} AS label" for x in labels)


# ---------------------------------------------------------------- text
DL = ("dl AS (SELECT d.doc_id, CAST(o.o_custkey % 10 AS INTEGER) AS label FROM documents d "
      "JOIN orders o ON o.o_orderkey = d.doc_id)")


def _toks(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')"


def _content(text: str = "text") -> str:
    return f"list_filter({_toks(text)}, lambda t: NOT list_contains({_sw()}, t))"


def _tfidf_ctes(docs_sql: str) -> str:
    """CTEs ending in ``tfidf(doc_id, term, tfidf)`` over ``dt(doc_id, text)``."""
    return (
        f"dt AS ({docs_sql}), "
        f"tok AS (SELECT doc_id, unnest({_content()}) AS term FROM dt), "
        "tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tok GROUP BY ALL), "
        "nd AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM dt), "
        "dfq AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term), "
        f"voc AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfq, nd WHERE df >= {R.MIN_DF} * n AND df <= {R.MAX_DF} * n), "
        "w AS (SELECT tf.doc_id, tf.term, tf.tf * voc.idf AS w FROM tf JOIN voc USING (term)), "
        "nrm AS (SELECT doc_id, sqrt(SUM(w * w)) AS nrm FROM w GROUP BY doc_id), "
        "tfidf AS (SELECT w.doc_id, w.term, w.w / nrm.nrm AS tfidf FROM w JOIN nrm USING (doc_id))"
    )


DOCS = "SELECT doc_id, text FROM documents"
ART_DOCS = "SELECT d.doc_id, d.text FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id"

CTW = "ctw AS (SELECT l.label, t.term, SUM(t.tfidf) AS weight FROM tfidf t JOIN dl l USING (doc_id) GROUP BY ALL)"


def _top_terms(src: str, n: int, name: str = "tt") -> str:
    return (f"{name} AS (SELECT * FROM (SELECT label, term, weight, row_number() OVER (PARTITION BY label "
            f"ORDER BY round(weight, 10) DESC, term) AS rank FROM {src}) WHERE rank <= {n})")


NAMES = (f"{_tfidf_ctes(ART_DOCS)}, {DL}, {CTW}, {_top_terms('ctw', 3)}, "
         "names AS (SELECT label, string_agg(term, ', ' ORDER BY rank) AS name FROM tt GROUP BY label)")


# ---------------------------------------------------------------- vectors
EX = ("ex AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, "
      "unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)")
CEN = ("cen AS (SELECT label, dim, AVG(v) AS value FROM ex GROUP BY ALL), "
       "cl AS (SELECT label, list(value ORDER BY dim) AS center FROM cen GROUP BY label)")
EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
VEC = f"{EX}, {CEN}, {EMB}"


def _pairs(kind: str) -> str:
    d = "list_distance(e.v, c.center)" if kind == "euclidean" else "1 - list_cosine_similarity(e.v, c.center)"
    return f"pairs AS (SELECT e.vec_id, c.label, {d} AS distance FROM emb e CROSS JOIN cl c)"


def _ranked_pairs(kind: str) -> str:
    return (f"{_pairs(kind)}, rp AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS rank "
            "FROM pairs)")


STATS = ("st AS (SELECT label, CAST(COUNT(*) AS DOUBLE) AS n, "
         "SUM(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS q FROM embeddings GROUP BY label), "
         "sums AS (SELECT label, dim, SUM(v) AS s FROM ex GROUP BY ALL)")

CH = (
    "chN AS (SELECT SUM(n) AS N, CAST(COUNT(*) AS DOUBLE) AS k FROM st), "
    "mu AS (SELECT dim, SUM(s) / (SELECT N FROM chN) AS mu FROM sums GROUP BY dim), "
    "trb AS (SELECT SUM(st.n * (sums.s / st.n - mu.mu) * (sums.s / st.n - mu.mu)) AS trb FROM sums JOIN st USING (label) JOIN mu USING (dim)), "
    "ss AS (SELECT label, SUM(s * s) AS ss FROM sums GROUP BY label), "
    "trw AS (SELECT SUM(st.q - ss.ss / st.n) AS trw FROM st JOIN ss USING (label)), "
    "ch AS (SELECT CASE WHEN trw = 0 THEN 1.0 ELSE trb * (N - k) / (trw * (k - 1)) END AS calinski_harabasz FROM trb, trw, chN)"
)

DB = (
    "pd AS (SELECT x.vec_id, x.label, sqrt(SUM((x.v - c.value) * (x.v - c.value))) AS d FROM ex x JOIN cen c USING (label, dim) GROUP BY x.vec_id, x.label), "
    "sc AS (SELECT label, AVG(d) AS S FROM pd GROUP BY label), "
    "cd AS (SELECT a.label AS li, b.label AS lj, sqrt(SUM((a.value - b.value) * (a.value - b.value))) AS d "
    "FROM cen a JOIN cen b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL), "
    "dbr AS (SELECT cd.li, MAX(CASE WHEN cd.d = 0 THEN 0.0 ELSE (si.S + sj.S) / cd.d END) AS m "
    "FROM cd JOIN sc si ON si.label = cd.li JOIN sc sj ON sj.label = cd.lj GROUP BY cd.li), "
    "db AS (SELECT CASE WHEN (SELECT SUM(S) FROM sc) = 0 THEN 0.0 ELSE AVG(m) END AS davies_bouldin FROM dbr)"
)

SIL = (
    "px AS (SELECT vec_id, label, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS x2 FROM embeddings), "
    "dotc AS (SELECT x.vec_id, s.label AS c, SUM(x.v * s.s) AS xs FROM ex x JOIN sums s USING (dim) GROUP BY ALL), "
    "msq AS (SELECT d.vec_id, d.c, p.label AS own, p.x2 + st.q / st.n - 2 * d.xs / st.n AS m, st.n AS cn "
    "FROM dotc d JOIN px p USING (vec_id) JOIN st ON st.label = d.c), "
    "per AS (SELECT vec_id, MAX(CASE WHEN c = own THEN m * cn / (cn - 1) END) AS a, MAX(CASE WHEN c = own THEN cn END) AS own_n, "
    "MIN(CASE WHEN c <> own THEN m END) AS b FROM msq GROUP BY vec_id), "
    "sil AS (SELECT AVG(CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END) AS silhouette FROM per)"
)

HREFS = ("hrefs AS (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href "
         "FROM (SELECT page_id, regexp_extract_all(html, 'href=\"(.+?)\"', 1) AS h FROM pages))")


def _stem(x: str) -> str:
    return f"split_part(string_split({x}, '/')[-1], '.', 1)"


POS = "pos AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, doc_id AS pmid FROM documents)"

ARTV = (
    "av AS (SELECT d.doc_id AS pmid, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, "
    "CASE WHEN o.o_orderstatus = 'F' THEN [o.o_orderpriority] ELSE CAST([] AS VARCHAR[]) END AS km, "
    "[d.source, d.lang] AS kn FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)"
)


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["completion_offset"] = f"WITH {OD}, {OA}, {OFF} SELECT offset_days FROM off"
    q["reconstruct_date"] = f"WITH {BASE} SELECT pmid, date FROM pred"
    q["extract_dates"] = (f"WITH {OD}, {OA} SELECT pmid, CAST(article_date AS TIMESTAMP) AS article_ts, "
                          "CAST(date_completed AS TIMESTAMP) AS completed_ts, CAST(date_revised AS TIMESTAMP) AS revised_ts FROM oa")
    q["docs_per_day"] = f"WITH {OD}, {OA}, {_dpd()} SELECT date, articles FROM dpd"
    q["docs_per_article_day"] = f"WITH {OD}, {OA}, {_dpd('article_date')} SELECT date, articles FROM dpd"
    q["docs_per_revised_day"] = f"WITH {OD}, {OA}, {_dpd('date_revised')} SELECT date, articles FROM dpd"
    q["rank_days"] = (f"WITH {OD}, {OA}, {_dpd()} SELECT date, articles, "
                      "CAST(row_number() OVER (ORDER BY articles DESC, date) AS INTEGER) AS rank FROM dpd")
    q["top_spike_dates"] = f"WITH {OD}, {OA}, {_dpd()}, {SPIKES} SELECT date FROM spikes"
    q["drop_spike_dates"] = (f"WITH {BASE}, {_dpd()}, {SPIKES} SELECT pmid, date, date_completed, label FROM pred p "
                             "WHERE NOT EXISTS (SELECT 1 FROM spikes s WHERE s.date = p.date_completed)")
    for unit in ("day", "week", "month", "quarter", "year"):
        q[f"label_trend_{unit}"] = f"WITH {BASE}, {_label_trend('pred', unit)} SELECT label, date, articles FROM lt"
    q["gap_filled_trend"] = (f"WITH {BASE}, {_label_trend('pred', 'month')}, {_gap_fill('lt', 'month')} "
                             "SELECT label, date, articles FROM filled")
    tm_fixed = _trend_matrix_ctes(_fixed_labels_sql(R.TREND_LABELS))
    q["trend_matrix"] = f"WITH {BASE}, {tm_fixed} SELECT date, label, articles FROM tm"
    wide_cols = ", ".join(
        f"CAST(COALESCE(MAX(CASE WHEN label = {int(x)} THEN articles END), 0) AS BIGINT) AS count_{int(x)}"
        for x in R.TREND_LABELS
    )
    q["trend_matrix_wide"] = f"WITH {BASE}, {tm_fixed} SELECT date, {wide_cols} FROM tm GROUP BY date"
    q["name_trends"] = (f"WITH {BASE}, {tm_fixed}, {NAMES} SELECT tm.label, tm.date, tm.articles, names.name "
                        "FROM tm LEFT JOIN names USING (label)")
    q["trend_series"] = (f"WITH {BASE}, {tm_fixed}, {NAMES}, nt AS (SELECT tm.label, tm.date, tm.articles, names.name "
                         "FROM tm LEFT JOIN names USING (label)) SELECT label, name, 'line' AS type, list(date ORDER BY date) AS x, "
                         "list(articles ORDER BY date) AS y FROM nt GROUP BY label, name")
    chosen = (f"SELECT label FROM cl ORDER BY 1 - list_cosine_similarity(center, {_vec(R.QUERY_VECTOR)}), label "
              f"LIMIT {R.CLOSEST_N}")
    q["trends_for_query"] = (f"WITH {BASE}, {EX}, {CEN}, {_trend_matrix_ctes(chosen)} "
                             "SELECT date, label, articles FROM tm")

    q["assemble_date"] = (
        "SELECT o_orderkey AS pmid, CASE WHEN y IS NULL OR m IS NULL OR d IS NULL THEN NULL ELSE "
        "CAST(try_strptime(trim(y) || '-' || lpad(trim(m), 2, '0') || '-' || lpad(trim(d), 2, '0'), '%Y-%m-%d') AS DATE) END AS date "
        "FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(o_custkey % 14 AS VARCHAR) AS m, "
        "CAST(day(o_orderdate) AS VARCHAR) AS d FROM orders)"
    )
    q["split_flagged_array"] = (
        "WITH kw AS (SELECT l_orderkey AS pmid, l_linenumber, ["
        "{'flag': CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'A' THEN NULL ELSE 'N' END, 'value': CAST(l_partkey AS VARCHAR)}, "
        "{'flag': CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END, 'value': CASE WHEN l_quantity > 25 THEN CAST(l_suppkey AS VARCHAR) END}, "
        "{'flag': CAST(NULL AS VARCHAR), 'value': CAST(l_linenumber AS VARCHAR)}] AS kw FROM lineitem), "
        "s AS (SELECT pmid, l_linenumber, list_transform(list_filter(kw, lambda k: k.flag = 'Y' AND k.value IS NOT NULL), lambda k: k.value) AS ma, "
        "list_transform(list_filter(kw, lambda k: COALESCE(k.flag, 'N') <> 'Y' AND k.value IS NOT NULL), lambda k: k.value) AS mi FROM kw) "
        "SELECT pmid, l_linenumber, CAST(len(ma) AS BIGINT) AS n_major, CAST(len(mi) AS BIGINT) AS n_minor, "
        "array_to_string(ma, ' ') AS major, array_to_string(mi, ' ') AS minor FROM s"
    )
    q["strip_inline_markup"] = (
        "SELECT page_id, trim(regexp_replace(html, "
        f"'{INLINE_MARKUP_PATTERN}', '', 'g')) AS text FROM pages"
    )
    q["combine_text"] = (
        f"WITH {ARTV} SELECT pmid, concat_ws(' ', COALESCE(title, ''), COALESCE(abstract, ''), "
        "COALESCE(array_to_string(km, ' '), ''), COALESCE(array_to_string(kn, ' '), '')) AS text, "
        "concat_ws(' ', COALESCE(title, ''), COALESCE(abstract, ''), '', '') AS text_default FROM av"
    )

    q["extract_hrefs"] = f"WITH {HREFS} SELECT page_id, pos, href FROM hrefs"
    q["filter_sorted_names"] = (f"WITH {HREFS} SELECT DISTINCT href AS name FROM hrefs "
                                f"WHERE ends_with(href, '{R.SUFFIX}')")
    q["last_n_files"] = (f"WITH {HREFS} SELECT name FROM (SELECT DISTINCT href AS name FROM hrefs "
                         f"WHERE ends_with(href, '{R.SUFFIX}')) ORDER BY name DESC LIMIT {R.LAST_N_FILES}")
    q["file_stem"] = f"SELECT page_id, {_stem('url')} AS file_stem FROM pages"
    q["content_digest"] = "SELECT doc_id, md5(text) AS digest FROM documents"
    from ..sources.tables import TABLES

    q["corpus_counts"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in TABLES
    )
    ledger = f"ledger AS (SELECT {_stem('href')} AS file_stem FROM hrefs)"
    listed = f"listed AS (SELECT {_stem('url')} AS file_stem FROM pages)"
    q["pending_files"] = (f"WITH {HREFS}, {ledger}, {listed} SELECT DISTINCT file_stem FROM listed l "
                          "WHERE NOT EXISTS (SELECT 1 FROM ledger g WHERE g.file_stem = l.file_stem)")
    q["ledger_register"] = (f"WITH {HREFS}, {ledger}, {listed} SELECT file_stem FROM ledger UNION "
                            "SELECT file_stem FROM listed")
    q["upsert_latest"] = (
        "WITH u AS (SELECT o_orderkey AS pmid, 0 AS seq, o_orderstatus AS value, 0 AS src FROM orders "
        "UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 1 FROM lineitem), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY seq DESC, src DESC, value DESC) AS rn FROM u) "
        "SELECT pmid, CAST(seq AS INTEGER) AS seq, value FROM r WHERE rn = 1"
    )
    q["latest_per_key"] = (
        "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER "
        "(PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations) WHERE rn = 1"
    )
    q["unpredicted_docs"] = ("SELECT doc_id AS pmid FROM documents d WHERE NOT EXISTS "
                             "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")

    q["scan_position"] = f"WITH {POS} SELECT pos, pmid FROM pos"
    q["sample_forward"] = f"WITH {POS} SELECT pos, pmid FROM pos WHERE pos < {R.SAMPLE_N}"
    q["sample_backward"] = (f"WITH {POS} SELECT pos, pmid FROM pos WHERE pos >= "
                            f"(SELECT COUNT(*) FROM documents) - {R.SAMPLE_N}")
    q["sample_uniform"] = (
        f"WITH {POS}, s AS (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{R.SAMPLE_SEED}'), doc_id "
        f"LIMIT {R.SAMPLE_N}) SELECT pos, pmid FROM pos WHERE pmid IN (SELECT doc_id FROM s)"
    )

    q["tokenize"] = (f"SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token "
                     f"FROM (SELECT doc_id, {_toks()} AS t FROM documents)")
    q["stopword_filter"] = (f"SELECT doc_id, CAST(len({_toks()}) AS BIGINT) AS n_tokens, "
                            f"CAST(len({_content()}) AS BIGINT) AS n_content FROM documents")
    q["ngrams"] = (
        f"WITH c AS (SELECT doc_id, {_content()} AS t FROM documents), "
        "g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i+1], ' ')))) AS term FROM c) "
        "SELECT doc_id, term, COUNT(*) AS tf FROM g GROUP BY ALL"
    )
    q["term_doc_freq"] = (f"WITH tok AS (SELECT doc_id, unnest({_content()}) AS term FROM documents), "
                          "tf AS (SELECT DISTINCT doc_id, term FROM tok) SELECT term, COUNT(*) AS df FROM tf GROUP BY term")
    q["tokenizer_term_freq"] = (
        "WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents), "
        "tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tok GROUP BY ALL) "
        "SELECT term, COUNT(*) AS df, CAST(SUM(tf) AS BIGINT) AS ttf FROM tf GROUP BY term")
    pairs = (
        f"tok AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_toks()} AS t FROM documents)), "
        f"kept AS (SELECT term FROM tok GROUP BY term HAVING COUNT(*) >= {R.WORD_MIN_COUNT}), "
        "near AS (SELECT a.term, b.term AS context, COUNT(*) AS n FROM tok a JOIN tok b ON a.doc_id = b.doc_id "
        f"AND a.pos <> b.pos AND a.pos - b.pos BETWEEN -{R.WORD_WINDOW} AND {R.WORD_WINDOW} GROUP BY ALL), "
        "pairs AS (SELECT * FROM near WHERE term IN (SELECT term FROM kept) AND context IN (SELECT term FROM kept))")
    ppmi = (
        f"{pairs}, rows_ AS (SELECT term, CAST(SUM(n) AS DOUBLE) AS nt FROM pairs GROUP BY term), "
        "ppmi AS (SELECT term, context, w FROM (SELECT p.term, p.context, "
        "ln(p.n * (SELECT SUM(pow(nt, 0.75)) FROM rows_) / (r.nt * pow(c.nt, 0.75))) - ln(2.0) AS w "
        "FROM pairs p JOIN rows_ r ON r.term = p.term JOIN rows_ c ON c.term = p.context) WHERE w > 0)")
    q["word_cooccurrence"] = f"WITH {pairs} SELECT term, context, n FROM pairs"
    q["word_ppmi"] = f"WITH {ppmi} SELECT term, context, round(w, 6) AS ppmi FROM ppmi"
    q["ppmi_projection"] = (
        f"WITH {ppmi}, idx AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM (SELECT DISTINCT term FROM ppmi)) "
        f"SELECT p.term, CAST(j AS BIGINT) AS j, round(SUM(w * sin(i + 2 * j)), 6) AS value FROM ppmi p JOIN idx ON idx.term = p.context, "
        f"range({R.PROJECTION_WIDTH}) t(j) GROUP BY ALL")
    q["df_pruned_vocab"] = f"WITH {_tfidf_ctes(DOCS)} SELECT term, df, round(idf, 6) AS idf FROM voc"
    q["tfidf"] = f"WITH {_tfidf_ctes(DOCS)} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf"
    base_ctw = f"{_tfidf_ctes(DOCS)}, {DL}, {CTW}"
    q["cluster_term_weights"] = f"WITH {base_ctw} SELECT label, term, round(weight, 6) AS weight FROM ctw"
    q["cluster_names"] = (f"WITH {base_ctw}, {_top_terms('ctw', 3)} SELECT label, string_agg(term, ', ' ORDER BY rank) AS name "
                          "FROM tt GROUP BY label")
    q["topic_names_top5"] = (f"WITH {base_ctw}, {_top_terms('ctw', 5)} SELECT label, string_agg(term, '_' ORDER BY rank) AS name "
                             "FROM tt GROUP BY label")
    q["class_tfidf_names"] = (
        f"WITH {DL}, tok AS (SELECT doc_id, unnest({_toks()}) AS term FROM documents), "
        "tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tok GROUP BY ALL), "
        "ctf AS (SELECT l.label, t.term, SUM(t.tf) AS ctf FROM tf t JOIN dl l USING (doc_id) GROUP BY ALL), "
        "ct AS (SELECT label, SUM(ctf) AS tot FROM ctf GROUP BY label), "
        "ttot AS (SELECT term, SUM(ctf) AS f FROM ctf GROUP BY term), "
        "av AS (SELECT CAST(floor(AVG(tot)) AS DOUBLE) AS a FROM ct), "
        "cw AS (SELECT c.label, c.term, (c.ctf / ct.tot) * ln(1 + av.a / ttot.f) AS weight "
        "FROM ctf c JOIN ct USING (label) JOIN ttot USING (term) CROSS JOIN av), "
        f"{_top_terms('cw', 4)} SELECT label, CAST(label AS VARCHAR) || '_' || string_agg(term, '_' ORDER BY rank) AS name "
        "FROM tt GROUP BY label"
    )

    q["topic_centroids"] = (f"WITH {EX}, {CEN}, sz AS (SELECT label, COUNT(*) AS size FROM embeddings GROUP BY label) "
                            "SELECT c.label, sz.size, CAST(c.dim AS INTEGER) AS dim, round(c.value, 6) AS value "
                            "FROM cen c JOIN sz USING (label)")
    q["topic_sizes"] = "SELECT label, COUNT(*) AS size FROM embeddings GROUP BY label"
    q["assign_nearest"] = (f"WITH {VEC}, {_ranked_pairs('euclidean')} SELECT vec_id, label, round(distance, 6) AS distance "
                           "FROM rp WHERE rank = 1")
    q["center_distances"] = f"WITH {VEC}, {_pairs('euclidean')} SELECT vec_id, label, round(distance, 6) AS distance FROM pairs"
    for kind in ("cosine", "euclidean"):
        q[f"{kind}_topk"] = (f"WITH {VEC}, {_ranked_pairs(kind)} SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, "
                             f"round(distance, 6) AS distance FROM rp WHERE rank <= {R.TOPK_PER_DOC}")
    q["nearest_topics"] = (
        f"WITH {EX}, {CEN}, s AS (SELECT label, 1 - list_cosine_similarity(center, {_vec(R.QUERY_VECTOR)}) AS distance FROM cl) "
        "SELECT label, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, label) AS INTEGER) AS rank "
        f"FROM s ORDER BY distance, label LIMIT {R.NEAREST_N}"
    )
    q["nearest_topics_euclidean"] = (
        f"WITH {EX}, {CEN}, s AS (SELECT label, list_distance(center, {_vec(R.QUERY_VECTOR)}) AS distance FROM cl) "
        "SELECT label, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, label) AS INTEGER) AS rank "
        f"FROM s ORDER BY distance, label LIMIT {R.NEAREST_N}"
    )
    q["similar_topics"] = (
        f"WITH {EX}, {CEN}, s AS (SELECT label, list_cosine_similarity(center, {_vec(R.QUERY_VECTOR)}) AS similarity FROM cl "
        "WHERE label <> -1) SELECT label, round(similarity, 6) AS similarity, "
        "CAST(row_number() OVER (ORDER BY similarity DESC, label) AS INTEGER) AS rank "
        f"FROM s ORDER BY similarity DESC, label LIMIT {R.NEAREST_N}"
    )
    q["predict_within_radius"] = (
        f"WITH {VEC}, {_ranked_pairs('euclidean')} SELECT vec_id, CASE WHEN distance <= {R.RADIUS} THEN label ELSE -1 END AS label "
        "FROM rp WHERE rank = 1"
    )
    q["calinski_harabasz"] = f"WITH {EX}, {STATS}, {CH} SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM ch"
    q["davies_bouldin"] = f"WITH {EX}, {CEN}, {DB} SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db"
    q["silhouette"] = f"WITH {EX}, {STATS}, {SIL} SELECT round(silhouette, 6) AS silhouette FROM sil"
    q["evaluate_clusters"] = (
        f"WITH {EX}, {CEN}, {STATS}, {CH}, {DB}, {SIL} SELECT round(sil.silhouette, 6) AS silhouette, "
        "round(ch.calinski_harabasz, 6) AS calinski_harabasz, round(db.davies_bouldin, 6) AS davies_bouldin FROM sil, ch, db"
    )
    todo = "SELECT pmid, date, date_completed, CAST(pmid % 10 AS INTEGER) AS label FROM pred"
    cap = f"LIMIT {R.PRECOMPUTE_CAP}"
    q["precompute_dates"] = f"WITH {BASE} {todo} WHERE pmid % 3 <> 0"
    q["precompute_capped_forward"] = f"WITH {BASE} {todo} WHERE pmid % 3 <> 0 ORDER BY pmid {cap}"
    q["precompute_capped_uniform"] = (f"WITH {BASE} {todo} WHERE pmid % 3 <> 0 "
                                      f"ORDER BY md5(CAST(pmid AS VARCHAR) || ':{R.SAMPLE_SEED}'), pmid {cap}")
    q["precompute_overwrite"] = (f"WITH {BASE}, n AS ({todo} ORDER BY pmid {cap}) SELECT * FROM n UNION ALL "
                                 "SELECT pmid, CAST(NULL AS DATE), date_completed, -1 FROM oa WHERE pmid % 3 = 0 AND pmid NOT IN (SELECT pmid FROM n)")
    q["precompute_overwrite_batches"] = q["precompute_overwrite"]
    q["trend_cube_matrix"] = q["trend_matrix"]
    q["embedding_precompute"] = (
        f"WITH {BASE}, {VEC}, {_ranked_pairs('euclidean')} SELECT pmid, date, date_completed, "
        f"CAST(CASE WHEN distance <= {R.RADIUS} THEN rp.label ELSE -1 END AS INTEGER) AS label "
        "FROM pred LEFT JOIN rp ON rp.vec_id = pmid AND rank = 1")
    q["upsert_across_files"] = (
        "SELECT pmid, file_stem, price FROM (SELECT o_custkey AS pmid, 'f' || CAST(o_orderkey % 4 AS VARCHAR) AS file_stem, o_totalprice AS price, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
    q["gap_filled_trend_day"] = (f"WITH {BASE}, {_label_trend('pred', 'day')}, {_gap_fill('lt', 'day')} "
                                 "SELECT label, date, articles FROM filled")
    q["event_trend_hour_filled"] = (
        "WITH c AS (SELECT event_type AS label, date_trunc('hour', ts) AS date, COUNT(*) AS n FROM events GROUP BY ALL), "
        "s AS (SELECT label, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS date FROM "
        "(SELECT label, CAST(MIN(date) AS TIMESTAMP) AS lo, CAST(MAX(date) AS TIMESTAMP) AS hi FROM c GROUP BY label)) "
        "SELECT s.label, strftime(s.date, '%Y-%m-%d %H:%M:%S') AS date, COALESCE(n, 0) AS articles FROM s LEFT JOIN c ON c.label = s.label AND c.date = s.date")
    q["event_trend_daily"] = ("SELECT event_type AS label, CAST(date_trunc('day', ts) AS DATE) AS date, COUNT(*) AS articles "
                              "FROM events GROUP BY ALL")
    q["event_trend_month"] = ("SELECT event_type AS label, CAST(date_trunc('month', ts) AS DATE) AS date, COUNT(*) AS articles "
                              "FROM events GROUP BY ALL")
    # greedy longest-match entity extraction: a recursive walk from one chosen
    # match to the first match starting at or after its end
    q["entity_text"] = (
        'WITH RECURSIVE\n'
        f"btok AS (SELECT regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS t FROM benchmark),\n"
        'bpos AS (SELECT t, unnest(range(len(t))) AS s FROM btok),\n'
        "bm AS (SELECT DISTINCT array_to_string(t[s + 1:s + n], ' ') AS phrase\n"
        '       FROM bpos, (VALUES (2), (3)) q(n) WHERE s + n <= len(t)),\n'
        f"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS t FROM documents),\n"
        'tpos AS (SELECT doc_id, t, unnest(range(len(t))) AS s FROM toks),\n'
        "cand AS (SELECT doc_id, s AS start, n, array_to_string(t[s + 1:s + n], ' ') AS phrase\n"
        '         FROM tpos, (VALUES (1), (2), (3)) q(n) WHERE s + n <= len(t)),\n'
        'm AS (SELECT c.doc_id, c.start, MAX(c.n) AS n FROM cand c JOIN bm USING (phrase) GROUP BY ALL),\n'
        'walk(doc_id, start, n, endpos) AS (\n'
        '  SELECT doc_id, start, n, start + n FROM m\n'
        '  WHERE start = (SELECT MIN(m2.start) FROM m m2 WHERE m2.doc_id = m.doc_id)\n'
        '  UNION ALL\n'
        '  SELECT m.doc_id, m.start, m.n, m.start + m.n FROM walk w JOIN m ON m.doc_id = w.doc_id\n'
        '  AND m.start = (SELECT MIN(m2.start) FROM m m2 WHERE m2.doc_id = w.doc_id AND m2.start >= w.endpos)\n'
        '),\n'
        "picked AS (SELECT w.doc_id, w.start, array_to_string(t.t[w.start + 1:w.start + w.n], ' ') AS phrase\n"
        '           FROM walk w JOIN toks t USING (doc_id))\n'
        "SELECT d.doc_id, COALESCE(p.text, '') AS text FROM documents d\n"
        "LEFT JOIN (SELECT doc_id, string_agg(phrase, ' ' ORDER BY start) AS text FROM picked GROUP BY doc_id) p USING (doc_id)\n"
    )
    # the same entity texts for the documents and the first benchmark text (id -1)
    first = "SELECT -1 AS doc_id, text FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)"
    ents = q["entity_text"].replace("FROM documents", "FROM src").replace("documents d", "src d")
    ctes, final = ents.split("WITH RECURSIVE\n", 1)[1].rsplit("SELECT d.doc_id", 1)
    q["entity_trends"] = (
        f"WITH RECURSIVE src AS (SELECT doc_id, text FROM documents UNION ALL {first}),\n{ctes.rstrip()},\n"
        f"ents AS (SELECT d.doc_id{final}), {BASE}, {DL}, "
        f"tok AS (SELECT doc_id, unnest({_content()}) AS term FROM ents), "
        "tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tok GROUP BY ALL), "
        "nd AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM documents), "
        "voc AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, COUNT(*) AS df FROM tf WHERE doc_id <> -1 GROUP BY term), nd), "
        "w AS (SELECT tf.doc_id, tf.term, tf.tf * voc.idf AS w FROM tf JOIN voc USING (term)), "
        "nrm AS (SELECT doc_id, sqrt(SUM(w * w)) AS nrm FROM w GROUP BY doc_id), "
        "ctw AS (SELECT l.label, w.term, SUM(w.w / nrm.nrm) AS weight FROM w JOIN nrm USING (doc_id) JOIN dl l USING (doc_id) GROUP BY ALL), "
        "qw AS (SELECT term, w AS weight FROM w WHERE doc_id = -1), "
        "cn AS (SELECT label, sqrt(SUM(weight * weight)) AS n FROM ctw GROUP BY label), "
        "sim AS (SELECT label, round(SUM(c.weight * qw.weight) / (any_value(cn.n) * (SELECT sqrt(SUM(weight * weight)) FROM qw)), 9) AS similarity "
        "FROM ctw c JOIN qw USING (term) JOIN cn USING (label) GROUP BY label), "
        f"{_trend_matrix_ctes('SELECT label FROM sim ORDER BY similarity DESC, label LIMIT ' + str(R.CLOSEST_N))} SELECT date, label, articles FROM tm")
    return q


ORACLE_SQL: dict[str, str] = _sql()
