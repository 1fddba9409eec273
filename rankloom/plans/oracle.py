"""The core's queries as SQL for DuckDB, written apart from the Spark plans."""

from __future__ import annotations

from collections.abc import Sequence

from rankloom.functions.text import STOPWORDS_ES

# White space as Python has it; DuckDB's \s is ASCII only.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_FULL = rf"CASE WHEN coalesce(title, '') <> '' THEN regexp_replace(title || '. ' || coalesce(text, ''), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') ELSE coalesce(text, '') END"
_WORDS = rf"CAST(len(regexp_extract_all(full_text, '[^{_SPACE}]+')) AS INT)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS_ES)
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_CTES = {
    "counted": f"SELECT *, {_WORDS} AS word_count FROM (SELECT docid, loaded_at, {_FULL} AS full_text FROM corpus)",
    "docs": "SELECT docid AS doc_id, full_text, word_count FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY loaded_at DESC NULLS LAST, word_count DESC, full_text DESC) AS n FROM counted WHERE docid IS NOT NULL) WHERE n = 1",
    "qr": "SELECT DISTINCT CAST(id AS VARCHAR) AS query_id, docid AS doc_id, CAST(1 AS INT) AS relevance FROM judgements WHERE id IS NOT NULL AND docid IS NOT NULL",
    "graded": "SELECT CAST(id AS VARCHAR) AS query_id, docid AS doc_id, max(coalesce(CAST(ceil(match_score * 3) AS INT), 0)) AS relevance FROM judgements WHERE id IS NOT NULL AND docid IS NOT NULL GROUP BY ALL",
    "kept": "SELECT doc_id FROM docs WHERE word_count <= 400",
    "pruned": "SELECT * FROM qr WHERE doc_id IN (SELECT doc_id FROM kept)",
    "qtexts": "SELECT query_id, text FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY issued_at DESC NULLS LAST, text DESC) AS n FROM queries WHERE query_id IS NOT NULL AND text IS NOT NULL) WHERE n = 1",
    "clean": "SELECT model, query_id, doc_id, max(score) AS score FROM retrieval_run WHERE model IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY ALL",
    "run": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM clean)",
    "normed": "SELECT *, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-9) AS norm FROM run WINDOW w AS (PARTITION BY model, query_id)",
    "fused": "SELECT query_id, doc_id, round(sum(1::DOUBLE / (60 + rank)) + 1e-12, 9) AS rrf, round(sum(0.05::DOUBLE * pow(0.95::DOUBLE, rank - 1)) + 1e-12, 9) AS rbc, round(count(*) * sum(1::DOUBLE / (rank * rank)) + 1e-12, 9) AS isr, round(count(*) * sum(norm) + 1e-12, 9) AS mnz FROM normed GROUP BY ALL",
    "lexico": "SELECT query_id, doc_id, rank, t.text AS query_text, coalesce(full_text, '') AS doc_text FROM run JOIN qtexts t USING (query_id) LEFT JOIN docs USING (doc_id) WHERE model = 'lexico'",
}
_NEEDS = {
    "docs": ["counted"], "kept": ["docs"], "pruned": ["qr", "kept"], "run": ["clean"], "normed": ["run"], "fused": ["normed"], "lexico": ["run", "qtexts", "docs"],
}


def _with(names: list[str], body: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({_CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra]
    return f"WITH {', '.join(parts)} {body}"


def _ranked(scored: str, keys: str = "query_id") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) AS INT) AS rank FROM ({scored})"


def _per_query(lists: str, keys: str, judged: str) -> list[tuple[str, str]]:
    """Extra tables whose last, ``scores``, has the metrics of each query."""
    return [
        ("lists", lists),
        ("ideal", f"SELECT query_id, sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN place <= 10 THEN relevance / log2(place + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM {judged}) GROUP BY query_id"),
        ("hits", f"SELECT l.*, relevance, row_number() OVER (PARTITION BY {keys}, query_id ORDER BY rank) AS so_far FROM lists l JOIN (SELECT * FROM {judged} WHERE relevance > 0) USING (query_id, doc_id)"),
        ("sums", f"SELECT {keys}, query_id, sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 100) AS h100, min(rank) FILTER (rank <= 10) AS first, sum(so_far::DOUBLE / rank) AS ap, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 50) AS h50 FROM hits GROUP BY ALL"),
        ("scores", f"SELECT {keys}, query_id, round(coalesce(dcg / nullif(ideal, 0), 0), 9) AS ndcg_10, round(coalesce(h100::DOUBLE / nullif(relevant, 0), 0), 9) AS recall_100, round(coalesce(1::DOUBLE / first, 0), 9) AS mrr_10, round(coalesce(ap / nullif(relevant, 0), 0), 9) AS map, round(coalesce(h10 / 10::DOUBLE, 0), 9) AS p_10, round(coalesce(h50 / 50::DOUBLE, 0), 9) AS p_50 FROM ideal CROSS JOIN (SELECT DISTINCT {keys} FROM lists) LEFT JOIN sums USING ({keys}, query_id)"),
    ]


_MEANS = "count(*) AS queries, " + ", ".join(f"round(avg({m}) + 1e-12, 6) AS {m}" for m in ("ndcg_10", "recall_100", "mrr_10", "map", "p_10", "p_50"))


def _stem(word: str) -> str:
    folded = f"translate({word}, 'áéíóúü', 'aeiouu')"
    return (
        f"CASE WHEN length({word}) < 5 THEN {word} WHEN suffix({folded}, 'eses') THEN regexp_replace({folded}, 'es$', '') WHEN suffix({folded}, 'ces') THEN regexp_replace({folded}, 'ces$', 'z') "
        f"WHEN regexp_matches({folded}, '(os|as|es)$') THEN regexp_replace({folded}, '(os|as|es)$', '') ELSE regexp_replace({folded}, '[oae]$', '') END"
    )


def _terms(table: str, key: str, text: str, es: bool) -> str:
    plain = f"SELECT {key} AS id, unnest({_TOKENS.format(text)}) AS w FROM {table}"
    term = f"SELECT id, {_stem('w')} AS term FROM ({plain}) WHERE w NOT IN ({_STOP})" if es else f"SELECT id, w AS term FROM ({plain})"
    return f"SELECT id, term, count(*) AS tf FROM ({term}) GROUP BY ALL"


def _bm25(es: bool) -> str:
    extra = [
        ("p", _terms("docs", "doc_id", "full_text", es)), ("q", _terms("qtexts", "query_id", "text", es)),
        ("dl", "SELECT doc_id AS id, coalesce(n, 0) AS dl FROM docs LEFT JOIN (SELECT id, sum(tf) AS n FROM p GROUP BY id) x ON x.id = doc_id"),
        ("tot", "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl"), ("df", "SELECT term, count(*) AS df FROM p GROUP BY term"),
        ("s", "SELECT q.id AS query_id, p.id AS doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * p.tf / (p.tf + 0.9::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl ON dl.id = p.id, tot GROUP BY ALL"),
    ]
    return _with(["docs", "qtexts"], f"SELECT * FROM ({_ranked('SELECT * FROM s WHERE score > 0')}) WHERE rank <= 100", extra)


def _vectors(table: str) -> str:
    return f"SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM {table} WHERE id IS NOT NULL AND len(embedding) = 128 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"


def _overlap(query: str, doc: str) -> str:
    q, t = _TOKENS.format(query), _TOKENS.format(doc)
    return f"coalesce(len(list_intersect(list_distinct({q}), list_distinct({t})))::DOUBLE / nullif(len(list_distinct({q})), 0), 0)"


def _summary(table: str, value: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont({value}::DOUBLE, {s}), 6) AS {n}" for s, n in ((0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
    return f"SELECT count({value}) AS n, min({value}) AS least, max({value}) AS greatest, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, {quantiles} FROM {table}"


def oracle_sql() -> dict[str, str]:
    """SQL by the names of the core's queries."""
    model_eval = _per_query("SELECT model, query_id, doc_id, rank FROM run", "model", "qr")
    out = {f"fuse_{n}": _with(["fused"], _ranked(f"SELECT query_id, doc_id, {c} AS score FROM fused")) for n, c in (("rrf", "rrf"), ("rbc", "rbc"), ("combmnz", "mnz"), ("isr", "isr"))}
    cells = [("model", "model"), ("strategy", "strategy"), ("params", "params"), ("ndcg_10", "ndcg@10"), ("recall_100", "recall@100"), ("mrr_10", "mrr@10"), ("map", "map"), ("p_10", "precision@10"), ("p_50", "precision@50")]
    formatted = ", ".join(f"printf('%.4f', round({c} + 1e-12, 4)) AS {c}" for c, _ in cells[3:])
    padded = " || ' | ' || ".join(f"rpad({c}, (SELECT greatest(max(length({c})), {len(t)})::INT FROM cells), ' ')" for c, t in cells)
    grid_scores = "SELECT combo, query_id, doc_id, unnest([{'strategy': 'mnz', 'params': '', 'score': mnz}, {'strategy': 'rbc', 'params': 'phi=0.95', 'score': rbc}, {'strategy': 'rrf', 'params': 'k=60', 'score': rrf}, {'strategy': 'isr', 'params': '', 'score': isr}], recursive := true) FROM wide"
    grid = [
        ("m", "SELECT DISTINCT model FROM retrieval_run WHERE model IS NOT NULL"),
        ("c", "SELECT a.model || '+' || b.model || '+' || c.model AS combo, unnest([a.model, b.model, c.model]) AS model FROM m a, m b, m c WHERE a.model < b.model AND b.model < c.model"),
        ("wide", "SELECT combo, query_id, doc_id, round(sum(1::DOUBLE / (60 + rank)) + 1e-12, 9) AS rrf, round(sum(0.05::DOUBLE * pow(0.95::DOUBLE, rank - 1)) + 1e-12, 9) AS rbc, round(count(*) * sum(1::DOUBLE / (rank * rank)) + 1e-12, 9) AS isr, round(count(*) * sum(norm) + 1e-12, 9) AS mnz FROM normed JOIN c USING (model) GROUP BY ALL"),
        ("melted", f"SELECT *, row_number() OVER (PARTITION BY combo, strategy, params, query_id ORDER BY score DESC, doc_id) AS rank FROM ({grid_scores})"),
    ]
    pairs_and_triples = "SELECT combo, unnest(l) AS model FROM (SELECT a.model || '+' || b.model || '+' || c.model AS combo, [a.model, b.model, c.model] AS l FROM m a, m b, m c WHERE a.model < b.model AND b.model < c.model UNION ALL SELECT a.model || '+' || b.model, [a.model, b.model] FROM m a, m b WHERE a.model < b.model)"
    sweep = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS phi, query_id, doc_id, round(sum((1 - {p}::DOUBLE) * pow({p}::DOUBLE, rank - 1)) + 1e-12, 9) AS score FROM run GROUP BY query_id, doc_id" for p in (0.8, 0.9, 0.95, 0.98))
    borda = [
        ("len", "SELECT model, query_id, count(*) AS n FROM run GROUP BY ALL"), ("cand", "SELECT DISTINCT query_id, doc_id FROM run"), ("c", "SELECT query_id, count(*) AS c FROM cand GROUP BY ALL"),
        ("s", "SELECT cand.query_id, cand.doc_id, round(sum(coalesce(c - rank + 1, (c - n + 1) / 2::DOUBLE)), 9) AS score FROM cand JOIN c USING (query_id) JOIN len USING (query_id) LEFT JOIN run ON run.model = len.model AND run.query_id = cand.query_id AND run.doc_id = cand.doc_id GROUP BY ALL"),
    ]
    condorcet = [
        ("mm", "SELECT list(DISTINCT model ORDER BY model) AS ms FROM run"),
        ("v", "SELECT query_id, doc_id, map_from_entries(list((model, rank))) AS r FROM run GROUP BY ALL"),
        ("x", "SELECT query_id, doc_id, list_transform(ms, lambda m: coalesce(r[m], 1000000)) AS ranks FROM v, mm"),
        ("pairs", "SELECT a.query_id, a.doc_id, list_sum(list_transform(list_zip(a.ranks, b.ranks), lambda z: sign(z[2] - z[1]))) > 0 AS won FROM x a JOIN x b ON a.query_id = b.query_id"),
        ("s", "SELECT query_id, doc_id, count(*) FILTER (won)::DOUBLE AS score FROM pairs GROUP BY ALL"),
    ]
    slots = ", ".join(f"embedding[{32 * i + 1}:{32 * i + 32}]::DOUBLE[]" for i in range(4))
    first = "SELECT id, embedding FROM (SELECT id, embedding, row_number() OVER (PARTITION BY id ORDER BY embedding) AS n FROM {} WHERE id IS NOT NULL AND len(embedding) = 128 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))) WHERE n = 1"
    maxsim = [
        ("q", f"SELECT id AS query_id, [{slots}] AS q FROM ({first.format('query_embeddings')})"), ("t", f"SELECT id AS doc_id, [{slots}] AS t FROM ({first.format('doc_embeddings')})"),
        ("s", "SELECT query_id, doc_id, round(coalesce(list_sum(list_transform(q, lambda x: list_max(list_transform(t, lambda y: list_cosine_similarity(x, y))))), 0), 6) AS score FROM run JOIN q USING (query_id) LEFT JOIN t USING (doc_id) WHERE model = 'denso_corto'"),
    ]
    hybrid = [
        ("n3", "SELECT *, (score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-9) AS norm FROM run WHERE model IN ('denso_corto', 'denso_largo', 'lexico') WINDOW w AS (PARTITION BY model, query_id)"),
        ("f", "SELECT DISTINCT query_id, doc_id FROM n3"),
        ("o", f"SELECT query_id, doc_id, {_overlap('t.text', 'coalesce(full_text, chr(32))')} AS o FROM f JOIN qtexts t USING (query_id) LEFT JOIN docs USING (doc_id)"),
    ]
    sparse = [
        ("p", _terms("docs", "doc_id", "full_text", True)), ("q", _terms("qtexts", "query_id", "text", True)), ("df", "SELECT term, count(*) AS df FROM p GROUP BY term"),
        ("s", "SELECT q.id AS query_id, p.id AS doc_id, round(sum(ln(1 + q.tf) * ln(1 + p.tf) * ln(1 + (SELECT count(*) FROM docs) / df::DOUBLE)), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term) GROUP BY ALL"),
    ]
    plain = _terms("docs", "doc_id", "full_text", False)
    chunks = [
        ("c", "SELECT word_count, (row_number() OVER (ORDER BY word_count, doc_id) - 1) // 200 AS chunk FROM docs"),
        ("w", "SELECT chunk, count(*) AS docs, max(word_count) AS max_words, CAST(floor(max(word_count) * 1.5) AS INT) AS tokens FROM c GROUP BY chunk"),
        ("s", "SELECT *, CAST(CASE WHEN tokens <= 512 THEN 512 WHEN tokens <= 2048 THEN 2048 WHEN tokens <= 8192 THEN 8192 WHEN tokens <= 16384 THEN 16384 ELSE 32768 END AS INT) AS sequence FROM w"),
        ("b", "SELECT *, CAST(CASE sequence WHEN 512 THEN 128 WHEN 2048 THEN 32 WHEN 8192 THEN 8 WHEN 16384 THEN 4 ELSE 2 END AS INT) AS batch FROM s"),
    ]
    # The density's series by the gamma function, where the query multiplies its terms up.
    even = "sin(a) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(a), 2 * j)))"
    odd = "2 / pi() * (a + CASE WHEN df > 1 THEN sin(a) * cos(a) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos(a), 2 * j))) ELSE 0 END)"
    union = f"nullif(len(list_distinct({_TOKENS.format('query_text')} || {_TOKENS.format('doc_text')})), 0)"
    out |= {
        "eval_fused": _with(["fused"], f"SELECT model, {_MEANS} FROM scores GROUP BY model", [("qr", _CTES["qr"]), *_per_query(f"SELECT 'rrf' AS model, query_id, doc_id, rank FROM ({_ranked('SELECT query_id, doc_id, rrf AS score FROM fused')})", "model", "qr")]),
        "fuse_borda": _with(["run"], _ranked("SELECT * FROM s"), borda),
        "fuse_condorcet": _with(["run"], _ranked("SELECT * FROM s"), condorcet),
        "fuse_all": _with(["fused"], "SELECT * FROM fused"),
        "fuse_rbc_phi_sweep": _with(["run", "qr"], f"SELECT phi, {_MEANS} FROM scores GROUP BY phi", _per_query(f"SELECT phi, query_id, doc_id, rank FROM ({_ranked(sweep, 'phi, query_id')})", "phi", "qr")),
        "fuse_grid_metrics": _with(["normed", "qr"], f"SELECT combo, strategy, params, {_MEANS} FROM scores GROUP BY ALL", [*grid, *_per_query("SELECT combo, strategy, params, query_id, doc_id, rank FROM melted", "combo, strategy, params", "qr")]),
        "fuse_grid": _with(["normed"], "SELECT combo, strategy, params, query_id, doc_id, score, CAST(rank AS INT) AS rank FROM melted", [("m", "SELECT DISTINCT model FROM retrieval_run WHERE model IS NOT NULL"), ("c", pairs_and_triples), *grid[2:]]),
        "fuse_combinations": "WITH m AS (SELECT DISTINCT model FROM retrieval_run WHERE model IS NOT NULL) SELECT combo, size, unnest(l) AS model FROM (SELECT a.model || '+' || b.model || '+' || c.model AS combo, 3::INT AS size, [a.model, b.model, c.model] AS l FROM m a, m b, m c WHERE a.model < b.model AND b.model < c.model UNION ALL SELECT a.model || '+' || b.model, 2::INT, [a.model, b.model] FROM m a, m b WHERE a.model < b.model)",
        "corpus_format_count": _with(["counted"], "SELECT docid, full_text, word_count FROM counted"),
        "corpus_wordcount_filter": _with(["counted"], "SELECT docid, word_count FROM counted WHERE word_count <= 400"),
        "corpus_kept_report": _with(["counted"], "SELECT count(*) AS original, count(*) FILTER (word_count <= 400) AS kept, round(count(*) FILTER (word_count <= 400) * 100.0::DOUBLE / nullif(count(*), 0), 4) AS kept_percent FROM counted"),
        "corpus_lookup": _with(["docs"], "SELECT * FROM docs"),
        "corpus_snippets": _with(["docs"], "SELECT doc_id, CASE WHEN length(full_text) > 80 THEN array_slice(full_text, 1, 80) || '...' ELSE full_text END AS shown FROM docs"),
        "qrels_build": _with(["qr"], "SELECT * FROM qr"),
        "qrels_test_rows": "SELECT DISTINCT CAST(id AS VARCHAR) AS query_id, docid AS doc_id, CAST(1 AS INT) AS relevance FROM judgements WHERE id IS NOT NULL AND docid IS NOT NULL AND split = 'test' AND match_score = 1 AND expanded_search = false",
        "qrels_graded": _with(["graded"], "SELECT * FROM graded"),
        "qrels_prune": _with(["pruned"], "SELECT * FROM pruned"),
        "qrels_prune_report": _with(["pruned"], "SELECT (SELECT count(DISTINCT query_id) FROM qr) AS queries_original, (SELECT count(*) FROM qr) AS pairs_original, (SELECT count(DISTINCT query_id) FROM pruned) AS queries_kept, (SELECT count(*) FROM pruned) AS pairs_kept"),
        "query_map_prune": _with(["pruned"], "SELECT query_id, text FROM (SELECT CAST(id AS VARCHAR) AS query_id, query AS text, row_number() OVER (PARTITION BY id ORDER BY judged_at DESC NULLS LAST, query DESC) AS n FROM judgements WHERE id IS NOT NULL AND query IS NOT NULL) WHERE n = 1 AND query_id IN (SELECT query_id FROM pruned)"),
        "query_map_last": _with(["qtexts"], "SELECT * FROM qtexts"),
        "qrels_nested": _with(["qr"], "SELECT query_id, '{' || string_agg('\"' || doc_id || '\":' || relevance, ',' ORDER BY doc_id) || '}' AS docs FROM qr GROUP BY query_id"),
        "dense_topk": f"WITH q AS ({_vectors('query_embeddings')}), t AS ({_vectors('doc_embeddings')}) SELECT * FROM ({_ranked('SELECT q.id AS query_id, t.id AS doc_id, round(max(list_inner_product(q.e, t.e)), 6) AS score FROM q, t GROUP BY ALL')}) WHERE rank <= 100",
        "bm25_term_stats": _with(["docs"], f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({plain}) GROUP BY term"),
        "bm25_doc_stats": _with(["docs"], f"SELECT doc_id AS id, CAST(len({_TOKENS.format('full_text')}) AS BIGINT) AS dl FROM docs"),
        "bm25_stems_es": _with(["docs"], f"SELECT term, {_stem('term')} AS stem FROM (SELECT DISTINCT term FROM ({plain}))"),
        "bm25_topk": _bm25(False),
        "bm25_topk_es": _bm25(True),
        "sparse_topk": _with(["docs", "qtexts"], f"SELECT * FROM ({_ranked('SELECT * FROM s WHERE score > 0')}) WHERE rank <= 100", sparse),
        "run_rank": _with(["run"], "SELECT * FROM run"),
        "run_minmax_norm": _with(["normed"], "SELECT model, query_id, doc_id, round(norm, 9) AS norm FROM normed"),
        "run_candidates": _with(["run"], "SELECT query_id, count(*) AS rows, count(DISTINCT doc_id) AS candidates FROM run GROUP BY query_id"),
        "eval_per_query": _with(["run", "qr"], "SELECT * FROM scores", model_eval),
        "eval_run": _with(["run", "qr"], f"SELECT model, {_MEANS} FROM scores GROUP BY model", model_eval),
        "eval_graded_ndcg": _with(["run", "graded"], "SELECT model, round(avg(ndcg_10) + 1e-12, 6) AS ndcg_10 FROM scores GROUP BY model", _per_query("SELECT model, query_id, doc_id, rank FROM run", "model", "graded")),
        "eval_paired_t": _with(
            ["run", "qr"], f"SELECT first, second, n, mean_delta, round(t, 4) AS t, round(greatest(0, 1 - CASE WHEN df % 2 = 0 THEN {even} ELSE {odd} END) + 1e-12, 6) AS p FROM (SELECT *, n - 1 AS df, atan(abs(t) / sqrt(n - 1)) AS a FROM pairs)",
            [*model_eval, ("pairs", "SELECT a.model AS first, b.model AS second, count(*) AS n, round(avg(round(a.ndcg_10 - b.ndcg_10, 9)) + 1e-12, 6) AS mean_delta, CASE WHEN stddev_samp(round(a.ndcg_10 - b.ndcg_10, 9)) > 1e-12 THEN avg(round(a.ndcg_10 - b.ndcg_10, 9)) / (stddev_samp(round(a.ndcg_10 - b.ndcg_10, 9)) / sqrt(count(*))) END AS t FROM scores a JOIN scores b USING (query_id) WHERE a.model < b.model GROUP BY ALL")],
        ),
        "results_table": _with(["run", "qr"], f"SELECT model, strategy, params, '| ' || {padded} || ' |' AS line FROM cells", [*model_eval, ("means", f"SELECT model, {_MEANS} FROM scores GROUP BY model"), ("cells", f"SELECT model, ' ' AS strategy, ' ' AS params, {formatted} FROM means")]),
        "encode_plan": _with(["docs"], "SELECT * FROM b", chunks),
        "encode_assigned": _with(["docs"], "SELECT sequence, batch, sum(docs)::BIGINT AS docs, max(max_words) AS longest FROM b GROUP BY ALL", chunks),
        "encode_terms": _with(["docs"], f"SELECT id, term, round(ln(1 + tf::DOUBLE), 6) AS weight FROM ({plain})"),
        "qrels_split": "SELECT DISTINCT CAST(id AS VARCHAR) AS query_id, docid AS doc_id, CAST(1 AS INT) AS relevance FROM judgements WHERE id IS NOT NULL AND docid IS NOT NULL AND split = (SELECT coalesce(max(split) FILTER (split = 'train'), min(split)) FROM judgements)",
        "qrels_split_fallback": "SELECT DISTINCT CAST(id AS VARCHAR) AS query_id, docid AS doc_id, CAST(1 AS INT) AS relevance FROM judgements WHERE id IS NOT NULL AND docid IS NOT NULL AND split = (SELECT coalesce(max(split) FILTER (split = 'corpus'), min(split)) FROM judgements)",
        "rerank_work": _with(["run", "docs"], "SELECT *, CAST(row_number() OVER (ORDER BY longest DESC, query_id) AS INT) AS place FROM (SELECT query_id, count(*) AS candidates, max(coalesce(word_count, 0)) AS longest FROM run LEFT JOIN docs USING (doc_id) WHERE model = 'lexico' GROUP BY query_id)"),
        "rerank_pointwise_scored": _with(["lexico"], _ranked(f"SELECT query_id, doc_id, round(coalesce(len(list_intersect(list_distinct({_TOKENS.format('query_text')}), list_distinct({_TOKENS.format('doc_text')})))::DOUBLE / {union}, 0), 6) AS score FROM lexico")),
        "encode_prompts": _with(["qtexts"], "SELECT query_id, 'Instruct: Dada una consulta, encuentra el pasaje que la responde' || chr(10) || 'Query: ' || text AS prompt FROM qtexts"),
        "rerank_candidates": _with(["lexico"], "SELECT * FROM lexico"),
        "rerank_pending": _with(["run"], "SELECT query_id, doc_id, rank FROM run WHERE model = 'lexico' AND query_id NOT IN (SELECT query_id FROM run WHERE model = 'cruzado')"),
        "rerank_pointwise": _with(["lexico"], _ranked(f"SELECT query_id, doc_id, round({_overlap('query_text', 'doc_text')}, 6) AS score FROM lexico")),
        "rerank_listwise": _with(["lexico"], _ranked("SELECT query_id, doc_id, round(o - avg(o) OVER (PARTITION BY query_id) + 1e-12, 6) AS score FROM o"), [("o", f"SELECT query_id, doc_id, {_overlap('query_text', 'doc_text')} AS o FROM lexico")]),
        "maxsim_topk": _with(["run"], _ranked("SELECT * FROM s"), maxsim),
        "hybrid_fuse_rerank": _with(["run", "qtexts", "docs"], _ranked("SELECT query_id, doc_id, round(o - avg(o) OVER (PARTITION BY query_id) + 1e-12, 6) AS score FROM o"), hybrid),
        "judgements_per_query_hist": "SELECT value, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS percent FROM (SELECT value, count(*) AS n FROM (SELECT id, count(*) AS value FROM judgements WHERE id IS NOT NULL GROUP BY id) GROUP BY value)",
        "judgements_summary": f"WITH c AS (SELECT count(*) AS judgements FROM judgements WHERE id IS NOT NULL GROUP BY id) {_summary('c', 'judgements')}",
        "length_summary_stats": _with(["counted"], _summary("counted", "word_count")),
        "length_hist_unit": _with(["counted"], "SELECT word_count AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM counted), 4) AS percent FROM counted GROUP BY word_count"),
        "length_hist_log": _with(["counted"], "SELECT CAST(floor(log10(word_count) / log10((SELECT max(word_count) FROM counted) + 1) * 79) AS INT) + 1 AS bin, count(*) AS n FROM counted WHERE word_count >= 1 GROUP BY bin"),
        "show_query": _with(["qr", "qtexts", "docs"], "SELECT query_id, text AS query, doc_id, CASE WHEN length(full_text) > 200 THEN array_slice(full_text, 1, 200) || '...' ELSE full_text END AS shown FROM qr JOIN qtexts USING (query_id) JOIN docs USING (doc_id) WHERE query_id = '100007'"),
        "model_slug_cache_key": "SELECT name, replace(name, '/', '__') AS slug, split_part(name, '/', -1) AS short, 'full_v1.2_q64_d256_' || CASE WHEN contains(name, 'denso') THEN 'filt400w' ELSE 'nofilter' END AS key FROM (SELECT DISTINCT 'grupo/' || model AS name FROM retrieval_run WHERE model IS NOT NULL)",
        "fusion_strategies": "SELECT * FROM (VALUES ('rrf', 'rrf', 'k=60'), ('rbc', 'rbc', 'phi=0.95'), ('combmnz', 'mnz', ''), ('isr', 'isr', ''), ('bordafuse', 'bordafuse', ''), ('condorcet', 'condorcet', '')) t(key, method, params)",
        "embeddings_by_chunk": "SELECT chunk, count(*) AS rows, CAST(sum(coalesce(len(embedding), 0)) AS BIGINT) AS numbers FROM doc_embeddings GROUP BY chunk",
    }
    return out
