"""DuckDB SQL of the core queries; those that SQL can't express, or only too slowly, have tests against brute force instead."""

from __future__ import annotations

from ..functions.text import LANGUAGES, THINKING

#: White space and word patterns as RE2 has them.
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NWS = _WS.replace("[", "[^", 1) + "+"
_WORD = r"[\p{L}\p{M}\p{N}_]+"


def _words(c: str) -> str:
    return f"len(regexp_extract_all(coalesce({c}, ''), '{_NWS}'))"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{_WORD}')"


def _base(c: str) -> str:
    return f"string_split(replace({c}, '\\', '/'), '/')[-1]"


_VEC = "v AS (SELECT vec_id AS ord, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), q AS (SELECT ord AS query_id, vector FROM v WHERE ord % 50 = 0)"
_COS = f"{_VEC}, s AS (SELECT query_id, ord, round(list_cosine_similarity(v.vector, q.vector), 6) AS score FROM v, q)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)"
_NORM = f"{_COS}, b AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM s GROUP BY 1), r AS (SELECT s.query_id, ord, score, round((score - lo) / (hi - lo + 1e-6), 6) AS score_norm, CAST({_RANK.replace('query_id', 's.query_id')} AS INTEGER) AS rank FROM s JOIN b USING (query_id))"


def _lexical(scheme: str, docs: str, queries: str, k: int) -> str:
    """CTEs ``lex(query_id, ord, score, rank)`` over CTEs docs(ord, text) and queries(query_id, text)."""
    words = _tokens("text") if scheme == "bm25" else f"list_filter({_tokens('text')}, lambda w: length(w) >= 2)"
    head = f"""
      {scheme}_d AS (SELECT ord, {words} AS words FROM {docs} WHERE text IS NOT NULL),
      {scheme}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(words)) AS avgdl FROM {scheme}_d),
      {scheme}_p AS (SELECT ord, len(words) AS dl, unnest(words) AS term FROM {scheme}_d),
      {scheme}_tf AS (SELECT ord, dl, term, count(*) AS tf FROM {scheme}_p GROUP BY ALL),
      {scheme}_df AS (SELECT term, count(*) AS df FROM {scheme}_tf GROUP BY 1),
      {scheme}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words}) AS term FROM {queries}) GROUP BY ALL),"""
    if scheme == "bm25":
        body = """
      bm25_i AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM bm25_df, bm25_n),
      bm25_w AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM bm25_i) ELSE idf END AS w FROM bm25_i),
      bm25_s AS (SELECT query_id, ord, round(sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM bm25_q JOIN bm25_w USING (term) JOIN bm25_tf USING (term), bm25_n GROUP BY ALL),"""
    else:
        body = """
      tfidf_w AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS w FROM tfidf_df, tfidf_n),
      tfidf_dn AS (SELECT ord, sqrt(sum((tf * w) ** 2)) AS scale FROM tfidf_tf JOIN tfidf_w USING (term) GROUP BY 1),
      tfidf_qn AS (SELECT query_id, sqrt(sum((qtf * w) ** 2)) AS size FROM tfidf_q JOIN tfidf_w USING (term) GROUP BY 1),
      tfidf_s AS (SELECT query_id, ord, round(sum(qtf * w * tf * w / scale / size), 6) AS score
        FROM tfidf_q JOIN tfidf_w USING (term) JOIN tfidf_tf USING (term) JOIN tfidf_dn USING (ord) JOIN tfidf_qn USING (query_id) GROUP BY ALL),"""
    return f"{head}{body}\n      {scheme}_r AS (SELECT query_id, ord, score, CAST({_RANK} AS INTEGER) AS rank FROM {scheme}_s QUALIFY {_RANK} <= {k})"


_DOCS = "docs AS (SELECT doc_id AS ord, text FROM documents), queries AS (SELECT item_id AS query_id, text FROM benchmark)"
_HYBRID = f"""v AS (SELECT doc_id AS ord, text, CAST(embedding AS DOUBLE[]) AS vector FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL),
  q AS (SELECT ord AS query_id, text, vector FROM v WHERE ord % 50 = 0),
  s AS (SELECT query_id, ord, round(list_cosine_similarity(v.vector, q.vector), 6) AS score FROM v, q),
  knn AS (SELECT query_id, ord, score, CAST({_RANK} AS INTEGER) AS rank FROM s QUALIFY {_RANK} <= 10),
  {_lexical('bm25', 'v', 'q', 10)}"""
_RANKED = f"{_HYBRID}, ranked AS (SELECT query_id, 0 AS retriever_idx, rank, ord, text FROM knn JOIN v USING (ord) UNION ALL SELECT query_id, 1, rank, ord, text FROM bm25_r JOIN v USING (ord))"


def _fused(source: str, order: str, budget: int) -> str:
    return f"""once AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY {order}) = 1),
      total AS (SELECT query_id, ord, CAST(row_number() OVER w AS INTEGER) AS place, CAST(sum({_words('text')}) OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_words
        FROM once WINDOW w AS (PARTITION BY query_id ORDER BY {order}))
      SELECT query_id, ord, place, total_words FROM total WHERE total_words <= {budget}"""


_LATEST = "SELECT collection, item, mtime, fetched_at, written_at FROM ({}) WHERE item IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection, item ORDER BY written_at DESC NULLS LAST, mtime DESC NULLS LAST, fetched_at DESC NULLS LAST, kind DESC NULLS LAST) = 1"
_TURNS = "t AS (SELECT conv_id, list(coalesce(content, '') ORDER BY turn, coalesce(content, '')) AS texts FROM history GROUP BY 1)"
_ATTR = "try_cast(trim(metadatas['{}'], ' ') AS BIGINT)"
_SOURCED = "d AS (SELECT * FROM documents WHERE source IS NOT NULL)"

_PY = _WS.replace("[", r"[\x1C-\x1F", 1)  # white space as Python has it


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_PY}+', ''), '{_PY}+$', '')"


def _first_sentence(c: str) -> str:
    """The stand-in model's answer to a prompt."""
    last = f"string_split({_strip(c)}, chr(10) || chr(10))[-1]"
    cases = " ".join(f"WHEN contains({last}, {m}) THEN left({_strip(f'string_split({last}, {m})[1]')}, 200) || {_strip(m)}" for m in ("'。'", "'. '", "'! '", "'? '", "chr(10)"))
    return f"CASE {cases} ELSE left({last}, 200) END"


def _overlap(query: str, text: str) -> str:
    """Share of the query's words that the text holds."""
    a, b = (f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '{_NWS}'))" for c in (query, text))
    return f"round(len(list_intersect({a}, {b})) / greatest(len({a}), 1), 6)"


def _halves(text: str, most: int) -> str:
    """List of a text's slices, whose width is halved until the first fits."""
    parts = f"list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536], lambda p: {_words(f'{text}[1:length({text}) // p]')} <= {most})[1]"
    width = f"greatest(1, length({text}) // {parts})"
    return f"list_transform(range(0, length({text}), {width}), lambda i: substring({text}, CAST(i + 1 AS BIGINT), {width}))"


def _packed(table: str, by: str, budget: int) -> str:
    """CTEs ``packed(by, bin, t)``: bins of consecutive texts of a group; the state of each row is its group number and the size so far."""
    return f"""o AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY doc_id) AS i, coalesce(text, '') AS t, {_words('text')} AS n FROM {table}),
      r AS (SELECT {by}, i, CASE WHEN n > {budget} THEN 0 ELSE n END AS size, 0 AS g, n > {budget} AS big FROM o WHERE i = 1
        UNION ALL SELECT o.{by}, o.i, CASE WHEN o.n > {budget} THEN 0 WHEN r.size + o.n > {budget} OR r.big THEN o.n ELSE r.size + o.n END, CASE WHEN o.n > {budget} OR r.big OR r.size + o.n > {budget} THEN r.g + 1 ELSE r.g END, o.n > {budget}
        FROM r JOIN o ON o.{by} IS NOT DISTINCT FROM r.{by} AND o.i = r.i + 1),
      b AS (SELECT r.{by}, r.g, 0 AS k, string_agg(o.t || chr(10), '' ORDER BY o.i) AS t FROM r JOIN o ON o.{by} IS NOT DISTINCT FROM r.{by} AND o.i = r.i WHERE NOT big GROUP BY ALL
        UNION ALL SELECT {by}, g, k, h[k] FROM (SELECT r.{by}, r.g, {_halves('t', budget)} AS h, unnest(generate_series(1, len(h))) AS k FROM r JOIN o ON o.{by} IS NOT DISTINCT FROM r.{by} AND o.i = r.i WHERE big)),
      packed AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY g, k) - 1 AS bin, t FROM b WHERE regexp_matches(t, '{_NWS}'))"""


_DRAWN = """w AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY source) AS total, ('0x' || left(md5('0:' || source), 8))::BIGINT % {size} AS shift,
    list(coalesce(text, '')) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING) AS texts FROM d),
  drawn AS (SELECT source, doc_id AS start, texts FROM w WHERE n >= shift AND (n - shift) % {size} = 0 AND n + {size} <= total)"""

ORACLES = {
    "rerank_stub": f"""WITH {_DOCS}, {_lexical('bm25', 'docs', 'queries', 20)}, p AS (SELECT r.query_id, r.ord, {_overlap('q.text', 'd.text')} AS score FROM bm25_r r JOIN docs d USING (ord) JOIN queries q ON q.query_id = r.query_id)
      SELECT query_id, ord, score, CAST({_RANK} AS INTEGER) AS rank FROM p WHERE score >= 0.2""",
    "auto_rerank_stub": f"""WITH {_HYBRID.replace("<= 10", "<= 20")}, good AS (SELECT query_id, ord, CAST({_RANK} AS INTEGER) AS rank FROM s WHERE score >= 0.3),
      few AS (SELECT query_id FROM good GROUP BY 1 HAVING count(*) < (SELECT greatest(10, count(*) // 10) FROM v WHERE len(list_filter(vector, lambda x: x <> 0)) > 0)),
      again AS (SELECT query_id, ord, CAST({_RANK} AS INTEGER) AS rank FROM (SELECT g.query_id, g.ord, {_overlap('q.text', 'v.text')} AS score FROM good g JOIN v USING (ord) JOIN q ON q.query_id = g.query_id)),
      kept AS (SELECT * FROM good WHERE query_id IN (SELECT query_id FROM few) UNION ALL SELECT * FROM again WHERE query_id NOT IN (SELECT query_id FROM few)),
      both_ AS (SELECT query_id, 0 AS tier, b.rank, ord, text FROM bm25_r b JOIN v USING (ord) WHERE score >= 70 AND rank <= 2 UNION ALL SELECT query_id, 1, rank, ord, text FROM kept JOIN v USING (ord)),
      f AS ({"WITH " + _fused('both_', 'tier, rank, ord', 800)}) SELECT query_id, ord, place FROM f""",
    "rag_answer_stub": f"""WITH {_HYBRID.replace("<= 10", "<= 5")}, both_ AS (SELECT query_id, 0 AS tier, b.rank, ord, text FROM bm25_r b JOIN v USING (ord) WHERE score >= 70 AND rank <= 2 UNION ALL SELECT query_id, 1, rank, ord, text FROM knn JOIN v USING (ord)),
      f AS ({"WITH " + _fused('both_', 'tier, rank, ord', 300)}), c AS (SELECT query_id, string_agg(text, chr(10) || '----------------' || chr(10) ORDER BY place) AS context, count(*) AS n FROM f JOIN v USING (ord) GROUP BY 1),
      p AS (SELECT q.query_id, 'Answer from the context.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || coalesce(context, '') AS p, coalesce(n, 0) AS n_chunks FROM q LEFT JOIN c USING (query_id))
      SELECT query_id, {_first_sentence('p')} AS answer, n_chunks FROM p""",
    "topic_questions_stub": f"""WITH {_HYBRID.replace("<= 10", "<= 5")}, k AS (SELECT query_id, rank, ord, text FROM knn JOIN v USING (ord)), f AS ({"WITH " + _fused('k', 'rank, ord', 300)}),
      c AS (SELECT query_id, string_agg(text, chr(10) ORDER BY place) AS t FROM f JOIN v USING (ord) GROUP BY 1)
      SELECT query_id, 'What is it about?' AS question, CAST(length('Write a question and its answer about this text, as ''question: ... answer: ...''.' || chr(10) || chr(10) || t) AS VARCHAR) AS answer FROM c""",
    "model_answers": f"SELECT qid, {_first_sentence('question')} AS reply FROM questions",
    "window_starts": f"WITH {_SOURCED}, {_DRAWN.format(size=3, last=2)} SELECT source, start FROM drawn",
    "create_questions_stub": f"""WITH {_SOURCED}, {_DRAWN.format(size=2, last=1)}, p AS (SELECT source, start, 'Write a question and its answer about this text, as ''question: ... answer: ...''.' || chr(10) || chr(10) || array_to_string(texts, chr(10)) AS p FROM drawn)
      SELECT source, start, 'What says ' || regexp_extract_all(p, '{_PY.replace("[", "[^", 1)}+')[-1] || '?' AS question, CAST(length(p) AS VARCHAR) AS answer FROM p""",
    "halve_oversize": f"""WITH h AS (SELECT doc_id, CASE WHEN {_words('text')} > 40 THEN {_halves('text', 40)} ELSE [text] END AS p FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(i - 1 AS INTEGER) AS part, CAST(length(p[i]) AS INTEGER) AS n_chars FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM h)""",
    "pack_calls": f"""WITH RECURSIVE {_SOURCED}, o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, {_words('text')} AS n FROM d),
      r AS (SELECT source, i, n AS size, 0 AS call, n FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.i, CASE WHEN 100 + r.size + o.n >= 1000 THEN o.n ELSE r.size + o.n END, CASE WHEN 100 + r.size + o.n >= 1000 THEN r.call + 1 ELSE r.call END, o.n FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
      SELECT source, CAST(call AS INTEGER) AS call, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY ALL""",
    "pack_documents": f"""WITH RECURSIVE {_SOURCED}, {_packed('d', 'source', 1000)}
      SELECT source, CAST(bin AS INTEGER) AS bin, CAST({_words('t')} AS BIGINT) AS n_tokens, md5(t) AS text_md5 FROM packed""",
    "ask_stub": f"""WITH RECURSIVE {_packed('documents', 'category', 3000)},
      a AS (SELECT category, bin, {_first_sentence("'What is this about?' || chr(10) || chr(10) || t")} AS answer, count(*) OVER (PARTITION BY category) AS n FROM packed WHERE category IS NOT NULL),
      k AS (SELECT * FROM a WHERE n <= 10 OR regexp_matches(answer, '{_NWS}')), f AS (SELECT * FROM k QUALIFY sum({_words('answer')}) OVER (PARTITION BY category ORDER BY bin ROWS UNBOUNDED PRECEDING) <= 3000),
      g AS (SELECT category, string_agg(answer, chr(10) ORDER BY bin) AS notes, max(n) AS n_bins FROM f GROUP BY 1)
      SELECT category, CASE WHEN n_bins = 1 THEN notes ELSE {_first_sentence("'Conclude.' || chr(10) || chr(10) || notes")} END AS answer, n_bins FROM g""",
    "process_db": f"""WITH {_SOURCED}, f AS (SELECT md5(source) AS place, {_strip("string_agg(translate(coalesce(text, ''), chr(10) || chr(13), '  '), chr(10) ORDER BY doc_id)")} AS t FROM d GROUP BY 1)
      SELECT place, 0 AS page, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS docs_md5, CAST(1 AS BIGINT) AS times_built FROM f""",
    "list_text_files": f"WITH {_SOURCED} SELECT md5(source) AS place, CAST(sum(strlen(translate(coalesce(text, ''), chr(10) || chr(13), '  ')) + 1) AS BIGINT) AS length FROM d GROUP BY 1",
    "csv_rows": """SELECT text_md5, count(*) AS n FROM (SELECT md5('doc_id: ' || doc_id || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || 'title: ' || coalesce(title, '')) AS text_md5 FROM documents
      UNION ALL SELECT md5('title: ' || coalesce(title, '') || chr(10) || 'category: ' || coalesce(category, '') || chr(10) || 'n_chars: ' || coalesce(n_chars::VARCHAR, '')) FROM documents) GROUP BY 1""",
    **{
        name: f"""SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 0 END AS page, CASE WHEN doc_id % 10 <> 0 THEN md5(coalesce(source, '') || chr(10) || coalesce(trim(lang, ' '), '')) END AS text_md5, doc_id % 10 = 0 AS failed FROM documents"""
        for name in ("docx_texts", "pptx_texts")
    },
    "info_texts": f"""WITH {_SOURCED}, f AS (SELECT sum(length(translate(coalesce(text, ''), chr(10) || chr(13), '  ')) + 1) AS n FROM d GROUP BY source)
      SELECT 'file' AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_chars FROM f UNION ALL SELECT 'text', 1, 11 UNION ALL SELECT 'page', 1, 18""",
    "essay_notes": "SELECT qid, CASE WHEN question_style = 'essay' AND qid % 2 = 0 THEN '請用中文回答 Be brief.' ELSE 'Be brief.' END AS system FROM questions",
    "json_rows": "SELECT run_id, CAST(to_json({'run_id': run_id, 'qid': qid, 'model': model, 'prompt': prompt}) AS VARCHAR) AS row FROM handle_table",
    "delete_by_collection": "SELECT collection, count(*) AS n, 1 AS deleted, 0 AS deleted_again FROM dbs WHERE collection IS DISTINCT FROM (SELECT min(collection) FROM dbs) GROUP BY 1",
    "store_roundtrip": """WITH m AS (SELECT min(collection) AS c FROM dbs)
      SELECT collection, ord, ids, md5(docs) AS docs_md5, (SELECT count(*) FROM dbs, m WHERE collection = c AND ord % 3 = 0) AS gone FROM dbs, m WHERE collection IS NOT NULL AND NOT (collection = c AND ord % 3 = 0)""",
    "directory_store": f"""WITH k AS (SELECT DISTINCT collection FROM dbs WHERE collection IS NOT NULL AND ids IS NOT NULL ORDER BY 1 LIMIT 5)
      SELECT ids, collection, source FROM dbs WHERE ids IS NOT NULL AND collection IN (SELECT collection FROM k) AND {_base('source')} IN ('manual_0011.pdf', 'report_0001.docx', 'manual_0003.docx')
      QUALIFY row_number() OVER (PARTITION BY ids ORDER BY collection, source, page NULLS FIRST) = 1""",
    "add_chunks": f"""SELECT ord, CAST(length(t) AS DOUBLE) AS n_chars, CAST(len(regexp_extract_all(t, '{_PY.replace("[", "[^", 1)}+')) AS DOUBLE) AS n_words FROM (SELECT ord, CASE WHEN ord % 3 = 0 THEN 'a title' ELSE docs END AS t FROM dbs WHERE docs IS NOT NULL)""",
    "embed_stub": f"""SELECT qid, CAST(length(question) AS DOUBLE) AS n_chars, CAST(len(regexp_extract_all(question, '{_PY.replace("[", "[^", 1)}+')) AS DOUBLE) AS n_words FROM questions""",
    "memory_nearest": f"""WITH m AS (SELECT min(run_id) AS ord, t FROM (SELECT run_id, 'User: ' || coalesce(prompt, '') || chr(10) || 'AI: ' || coalesce(response, '') AS t FROM handle_table WHERE regexp_matches(coalesce(prompt, ''), '{_NWS}') OR regexp_matches(coalesce(response, ''), '{_NWS}')) GROUP BY t),
      v AS (SELECT ord, length(t) AS a, len(regexp_extract_all(t, '{_PY.replace("[", "[^", 1)}+')) AS b FROM m),
      q AS (SELECT CAST(qid AS BIGINT) AS query_id, length(question) AS a, len(regexp_extract_all(question, '{_PY.replace("[", "[^", 1)}+')) AS b FROM questions WHERE qid % 50 = 0),
      s AS (SELECT query_id, ord, round(1 / (1 + CAST((v.a - q.a) ** 2 + (v.b - q.b) ** 2 AS DOUBLE)), 6) AS score FROM v, q)
      SELECT query_id, ord, CAST({_RANK} AS INTEGER) AS place FROM s QUALIFY place <= 3""",
    "questions_roundtrip": "SELECT qid, question_style, question_type, question, array_to_string(choices, '|') AS choices, answer FROM questions",
    "logs_roundtrip": "SELECT run_id, model, md5(prompt) AS prompt_md5, md5(response) AS response_md5 FROM handle_table",
    "saved_json": "SELECT qid, question, answer FROM questions",
    "experiment_metrics": " UNION ALL ".join(
        [f"SELECT '{c}' AS key, round(avg({c}) FILTER (NOT isnan({c})), 6) AS value FROM handle_table" for c in ("bert", "rouge", "llm_score")]
        + [f"SELECT '{c}', CAST(count(DISTINCT {c}) AS DOUBLE) FROM handle_table" for c in ("model", "lang")]
        + ["SELECT 'runs', CAST(count(*) AS DOUBLE) FROM handle_table"]
    ),
    "memory_stream": f"""WITH m AS (SELECT run_id, 'User: ' || coalesce(prompt, '') || chr(10) || 'AI: ' || coalesce(response, '') AS t FROM handle_table WHERE regexp_matches(coalesce(prompt, ''), '{_NWS}') OR regexp_matches(coalesce(response, ''), '{_NWS}'))
      SELECT (length(t) % 7)::VARCHAR || ' parts' AS category, count(*) AS n, min(run_id) AS first_ord, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM m GROUP BY 1""",
    "memory_markdown": "SELECT 'group ' || (run_id % 5)::VARCHAR AS file, CAST(sum(length('## 2025' || chr(10) || prompt || chr(10)) + 1) AS BIGINT) AS n_chars FROM handle_table WHERE prompt IS NOT NULL GROUP BY 1",
    "web_search_stub": "SELECT 'T' || i AS title, 'https://x.test/' || i AS url, 'tokens ' || i AS text FROM range(5) t(i)",
    "url_refresh": f"""WITH b AS ({_LATEST.format("SELECT * FROM ledger WHERE kind = 'url'")}), due AS (SELECT collection, item FROM b WHERE NOT coalesce(fetched_at + INTERVAL 30 DAY >= TIMESTAMPTZ '2025-06-01 00:00:00+00', false))
      SELECT collection, item AS url, 'T' AS title, md5('T page of ' || item) AS text_md5, count(*) OVER (PARTITION BY collection) AS due FROM due WHERE collection IS NOT NULL""",
    "rerank_reduce_stub": f"""WITH {_DOCS}, {_lexical('bm25', 'docs', 'queries', 20)}, p AS (SELECT r.query_id, r.ord, {_overlap('q.text', 'd.text')} AS score FROM bm25_r r JOIN docs d USING (ord) JOIN queries q ON q.query_id = r.query_id)
      SELECT query_id, ord, score, CAST({_RANK} AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
    "bert_stub": f"""WITH w AS (SELECT run_id, list_distinct(regexp_extract_all(lower(response), '{_PY.replace("[", "[^", 1)}+')) AS a, list_distinct(regexp_extract_all(lower(prompt), '{_PY.replace("[", "[^", 1)}+')) AS b FROM handle_table)
      SELECT run_id, coalesce(round(2.0::DOUBLE * len(list_intersect(a, b)) / greatest(len(a) + len(b), 1), 3), 0.0::DOUBLE) AS f1 FROM w""",
    "toxicity_stub": "SELECT run_id, round(CASE WHEN run_id % 3 = 0 THEN (run_id % 10) / 10 ELSE 1 - (run_id % 10) / 10 END, 6) AS toxicity FROM handle_table",
    "evaluation_scores": """WITH c AS (SELECT qid, min(array_to_string(inputs, ' ')) AS context FROM handle_table WHERE qid IS NOT NULL GROUP BY 1),
      p AS (SELECT q.*, CASE WHEN question_type = 'summary' THEN 'Summarise this text.' || chr(10) || chr(10) || coalesce(question, '')
          ELSE coalesce(context, '') || chr(10) || chr(10) || question || CASE WHEN len(choices) > 0 THEN chr(10) || array_to_string(list_transform(choices, lambda c, i: i::VARCHAR || '. ' || c), chr(10)) ELSE '' END END AS p FROM questions q LEFT JOIN c USING (qid)),
      r AS (SELECT *, string_split(p, chr(10))[-1] AS response FROM p)
      SELECT qid, md5(response) AS response_md5, CASE WHEN question_style = 'essay' THEN round(least(1.0::DOUBLE, length('Grade from 0 to 1.' || chr(10) || chr(10) || coalesce(response, '') || chr(10) || chr(10) || coalesce(answer, '')) / 1000), 3) END AS llm_score,
        CASE WHEN question_style <> 'essay' THEN CASE WHEN coalesce(contains(response, replace(answer, ' ', '')), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS hit FROM r""",
    "translate_stub": "SELECT qid, CASE WHEN strlen(question) = length(question) THEN upper(question) ELSE question END AS translated FROM questions",
    "json_call_stub": "SELECT qid, CAST(length(coalesce(question, '')) AS INTEGER) AS length FROM questions",
    "relevant_stub": "SELECT run_id FROM handle_table WHERE contains(string_split(response, chr(10) || chr(10) || 'Question: ')[1], 'chunk')",
    "tool_functions": "SELECT qid, '<' || question || '>' AS framed, 'puts a text in marks, args: {text:str}' AS explained FROM questions",
    "tool_results": """SELECT qid, CASE qid % 3 WHEN 0 THEN question WHEN 1 THEN '{"n":' || qid || '}' ELSE '[{"type":"text","text":"a"},{"type":"text","text":"b"}]' END AS result FROM questions""",
    "character_map": "SELECT doc_id, md5(translate(text, '后国问题检', '後國問題檢')) AS text_md5 FROM documents",
    "han_token_counts": rf"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(regexp_replace(lower(text), '([\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}])', ' \1 ', 'g'), '{_WORD}')), 0) AS INTEGER) AS n_tokens, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars FROM documents",
    "budget_prefix_characters": f"WITH {_SOURCED}, t AS (SELECT source, doc_id, CAST(sum(coalesce(length(text), 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM d) SELECT * FROM t WHERE total <= 9000",
    "filter_none": "SELECT ord, 0 AS n_matched FROM dbs",
    "filter_parser": f"SELECT ord FROM dbs WHERE {_ATTR.format('chunk_size')} > 500 AND contains(lower(metadatas['title']), 'notes')",
    "call_estimate": """WITH RECURSIVE c AS (SELECT lang, count(*) AS chunks FROM documents GROUP BY 1),
      p AS (SELECT lang, chunks, CAST(greatest(2, floor((CASE WHEN contains(CASE lower(trim(lang, ' ')) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + """ ELSE 'traditional chinese' END, 'chinese') THEN 2 ELSE 1 END * 3000 - 500) / 1000)) AS BIGINT) AS per_call FROM c),
      r AS (SELECT lang, per_call, CAST(chunks AS BIGINT) AS n, 0::BIGINT AS calls FROM p UNION ALL SELECT lang, per_call, CAST(ceil(n / per_call) AS BIGINT), calls + CAST(ceil(n / per_call) AS BIGINT) FROM r WHERE n > 1)
      SELECT p.lang, chunks, p.per_call, max(calls) AS calls FROM p JOIN r ON p.lang IS NOT DISTINCT FROM r.lang GROUP BY ALL""",
    "stream_ingest": """SELECT collection, item, item || ' ' || CAST(CAST(round(mtime * 1000) AS BIGINT) AS VARCHAR) AS text FROM (SELECT collection, item, max(mtime) AS mtime FROM ledger WHERE kind = 'file' AND item IS NOT NULL GROUP BY ALL)""",
    "stream_fetches": "SELECT make_timestamptz(CAST(floor(epoch(fetched_at) / 2592000) AS BIGINT) * 2592000000000) AS start, count(DISTINCT item) AS urls FROM ledger WHERE kind = 'url' AND fetched_at IS NOT NULL GROUP BY 1",
    "project_chunks": "SELECT ord, ids, coalesce(docs, '') AS docs, CAST(coalesce(len(embeds), 0) AS INTEGER) AS dims FROM dbs",
    "first_chunks": "SELECT ord, source FROM dbs ORDER BY ord LIMIT 100",
    "filter_by_file": f"SELECT ord, source FROM dbs WHERE {_base('source')} IN ('manual_0011.pdf', 'report_0001.docx', 'manual_0003.docx')",
    "filter_by_keyword": "SELECT ord, CASE WHEN contains(docs, 'token counter') THEN 0 WHEN contains(docs, 'chunk_size') THEN 1 ELSE 2 END AS keyword_no FROM dbs WHERE contains(docs, 'token counter') OR contains(docs, 'chunk_size') OR contains(docs, '向量')",
    "filter_by_ids": "SELECT ord, ids FROM dbs WHERE ids IN (SELECT ids FROM dbs WHERE ord % 50 = 0)",
    "pop_by_ids": "SELECT ord, ids FROM dbs WHERE ids IS NULL OR ids NOT IN (SELECT ids FROM dbs WHERE ord % 50 = 0 AND ids IS NOT NULL)",
    "filter_metadata": f"""WITH m AS (SELECT ord, coalesce({_ATTR.format('chunk_size')} >= 1000, false) AS a, coalesce({_ATTR.format('chunk_overlap')} < 200, false) AS b, coalesce(contains(lower(metadatas['title']), 'release'), false) AS c FROM dbs)
      SELECT ord, array_to_string(list_filter([CASE WHEN a THEN 'chunk_size' END, CASE WHEN b THEN 'chunk_overlap' END, CASE WHEN c THEN 'title' END], lambda x: x IS NOT NULL), ',') AS matched FROM m WHERE a AND (b OR c)""",
    "filter_metadata_loose": f"""WITH m AS (SELECT ord, coalesce(contains(lower(metadatas['title']), 'notes'), false) AS a, coalesce({_ATTR.format('chunk_size')} <> 1000, false) AS b FROM dbs)
      SELECT ord, array_to_string(list_filter([CASE WHEN a THEN 'title' END, CASE WHEN b THEN 'chunk_size' END], lambda x: x IS NOT NULL), ',') AS matched FROM m WHERE a OR b""",
    "self_query_stub": "SELECT ord, 'url' AS matched FROM dbs WHERE contains(lower(metadatas['url']), '/guide/')",
    "non_blank_chunks": f"SELECT ord FROM dbs WHERE regexp_matches(docs, '{_NWS}')",
    "merge_stores": """WITH a AS (SELECT ids, ord FROM dbs WHERE page IS NULL), b AS (SELECT ids, ord FROM dbs WHERE page IS NOT NULL)
      SELECT * FROM a UNION ALL SELECT ids, min(ord) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.ids IS NOT DISTINCT FROM b.ids) GROUP BY ids""",
    "append_stores": "SELECT ids, ord FROM dbs",
    "update_metadata": """SELECT ord, CASE WHEN c.ids IS NOT NULL THEN 'changed' ELSE d.metadatas['state'] END AS state, CASE WHEN c.ids IS NULL THEN d.metadatas['chunk_size'] END AS chunk_size
      FROM dbs d LEFT JOIN (SELECT DISTINCT ids FROM dbs WHERE ord % 3 = 0 AND ids IS NOT NULL) c ON d.ids = c.ids""",
    "delete_by_file": f"""WITH gone AS (SELECT DISTINCT {_base('item')} AS file FROM ledger WHERE kind = 'file' AND item IS NOT NULL AND {_base('item')} LIKE 'report%')
      SELECT ord, source FROM dbs WHERE source IS NULL OR {_base('source')} NOT IN (SELECT file FROM gone)""",
    "ledger_current": f"SELECT collection, item, mtime, written_at FROM ({_LATEST.format('SELECT * FROM ledger')})",
    "ledger_file_status": f"""WITH f AS (SELECT collection, item, max(mtime) AS mtime FROM ledger WHERE kind = 'file' AND item IS NOT NULL GROUP BY ALL),
      b AS ({_LATEST.format("SELECT * FROM ledger WHERE kind = 'file' AND written_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'")})
      SELECT f.collection, f.item, CASE WHEN b.item IS NULL THEN 'NOT_BUILT' WHEN f.mtime IS NOT DISTINCT FROM b.mtime THEN 'ALREADY_BUILT' ELSE 'OLD_BUILT' END AS status
      FROM f LEFT JOIN b ON f.collection = b.collection AND f.item = b.item""",
    "ledger_url_status": f"""WITH f AS (SELECT DISTINCT collection, item FROM ledger WHERE kind = 'url' AND item IS NOT NULL), b AS ({_LATEST.format("SELECT * FROM ledger WHERE kind = 'url'")})
      SELECT f.collection, f.item, CASE WHEN b.item IS NULL THEN 'NOT_BUILT' WHEN coalesce(b.fetched_at + INTERVAL 30 DAY >= TIMESTAMPTZ '2025-06-01 00:00:00+00', false) THEN 'ALREADY_BUILT' ELSE 'OLD_BUILT' END AS status
      FROM f LEFT JOIN b ON f.collection = b.collection AND f.item = b.item""",
    "dedupe_text": "SELECT min(ord) AS ord FROM dbs GROUP BY docs",
    "group_concat_ref": """WITH k AS (SELECT ord, coalesce(docs, '') AS t, CASE WHEN metadatas['source'] IS NOT NULL AND metadatas['page'] IS NOT NULL THEN metadatas['source'] ELSE metadatas['url'] END AS ref,
        CASE WHEN metadatas['source'] IS NOT NULL AND metadatas['page'] IS NOT NULL THEN metadatas['page'] ELSE metadatas['title'] END AS part FROM dbs)
      SELECT ref, part, md5(string_agg(t, '' ORDER BY ord)) AS text_md5, count(*) AS n_chunks FROM k WHERE ref IS NOT NULL AND part IS NOT NULL GROUP BY ALL""",
    "group_pages": "SELECT source, array_to_string(list(DISTINCT page ORDER BY page), ',') AS pages FROM dbs WHERE page IS NOT NULL AND source IS NOT NULL GROUP BY 1",
    "files_by_parent": f"""WITH f AS (SELECT DISTINCT regexp_extract(regexp_replace(replace(source, '\\', '/'), '^\\./', ''), '^(.*)/', 1) AS parent, {_base('source')} AS file FROM dbs WHERE source IS NOT NULL AND NOT regexp_matches(source, '^https?://'))
      SELECT parent, count(*) AS n_files, min(file) AS first_file, max(file) AS last_file FROM f GROUP BY 1""",
    "source_phrase": f"SELECT collection, '根據文件' || string_agg(DISTINCT split_part({_base('source')}, '.', 1), '、' ORDER BY split_part({_base('source')}, '.', 1)) AS phrase FROM dbs WHERE NOT regexp_matches(source, '^https?://') GROUP BY 1",
    "same_category": """WITH i AS (SELECT category, source, min(doc_id) AS place FROM documents WHERE category IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
      SELECT category, count(*) AS n, min(place) AS first_at, string_agg(source, '|' ORDER BY place, source) AS nouns FROM i GROUP BY 1 HAVING count(*) >= 3""",
    "mean_scores": "SELECT model, count(*) AS n, " + ", ".join(f"round(avg({c}) FILTER (NOT isnan({c})), 3) AS {c}" for c in ("bert", "rouge", "llm_score")) + " FROM handle_table GROUP BY 1",
    "choice_accuracy": """SELECT question_type, count(*) AS n, round(avg(CASE WHEN coalesce(contains(response, replace(answer, ' ', '')), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
      FROM handle_table JOIN questions USING (qid) WHERE question_style = 'single_choice' GROUP BY 1""",
    "df_stats": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens('text')})) AS term FROM documents) GROUP BY 1",
    "length_stats": f"SELECT lang, count(*) AS n, CAST(sum({_words('text')}) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "knn_cosine": f"WITH {_NORM} SELECT * FROM r WHERE rank <= 10",
    "knn_threshold": f"WITH {_NORM} SELECT query_id, ord, rank FROM r WHERE rank <= 20 AND score_norm >= 0.7",
    "l2_flat": f"WITH {_VEC}, s AS (SELECT query_id, ord, round(1 / (1 + list_distance(v.vector, q.vector) ** 2), 6) AS score FROM v, q) SELECT query_id, ord, score, CAST({_RANK} AS INTEGER) AS rank FROM s QUALIFY {_RANK} <= 10",
    "vector_norms": f"WITH {_VEC} SELECT ord, round(list_cosine_similarity(vector, list_resize([0.5::DOUBLE], 64, 0.5)), 6) AS cos, round(list_distance(vector, list_resize([0.5::DOUBLE], 64, 0.5)) ** 2, 6) AS d2 FROM v",
    "knn_store": f"""WITH v AS (SELECT ord, CAST(embeds AS DOUBLE[]) AS vector FROM dbs WHERE len(embeds) = 64 AND len(list_filter(embeds, lambda x: isfinite(x))) = 64 AND len(list_filter(embeds, lambda x: x <> 0)) > 0),
      s AS (SELECT q.ord AS query_id, v.ord, round(list_cosine_similarity(v.vector, q.vector), 6) AS score FROM v, v q WHERE q.ord % 50 = 0)
      SELECT query_id, ord, score, CAST({_RANK} AS INTEGER) AS rank FROM s QUALIFY {_RANK} <= 5""",
    "mmr_topk": f"""WITH {_COS}, p AS (SELECT query_id, ord, score FROM s),
      one AS (SELECT query_id, ord, score FROM p QUALIFY {_RANK} = 1),
      near1 AS (SELECT p.query_id, p.ord, p.score AS rel, round(list_cosine_similarity(a.vector, b.vector), 6) AS near FROM p JOIN one USING (query_id) JOIN v a ON a.ord = p.ord JOIN v b ON b.ord = one.ord WHERE p.ord <> one.ord),
      two AS (SELECT query_id, ord, round(0.5 * rel - 0.5 * near, 6) AS score FROM near1 QUALIFY {_RANK} = 1),
      near2 AS (SELECT n.query_id, n.ord, n.rel, greatest(n.near, round(list_cosine_similarity(a.vector, b.vector), 6)) AS near FROM near1 n JOIN two USING (query_id) JOIN v a ON a.ord = n.ord JOIN v b ON b.ord = two.ord WHERE n.ord <> two.ord),
      three AS (SELECT query_id, ord, round(0.5 * rel - 0.5 * near, 6) AS score FROM near2 QUALIFY {_RANK} = 1)
      SELECT *, 1 AS rank FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three""",
    "custom_retriever": f"""WITH {_VEC}, f AS (SELECT query_id, v.ord, list_distance(v.vector, q.vector) AS far FROM v, q)
      SELECT query_id, ord, CAST(row_number() OVER w AS INTEGER) AS rank FROM f WINDOW w AS (PARTITION BY query_id ORDER BY far DESC, ord) QUALIFY rank <= 3""",
    "recall_at_k": f"""WITH {_COS}, n AS (SELECT query_id, ord FROM s QUALIFY {_RANK} <= 11)
      SELECT query_id, round(avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM n JOIN embeddings a ON a.vec_id = n.ord JOIN embeddings b ON b.vec_id = n.query_id WHERE ord <> query_id GROUP BY 1""",
    "bm25_topk": f"WITH {_DOCS}, {_lexical('bm25', 'docs', 'queries', 5)} SELECT * FROM bm25_r",
    "tfidf_topk": f"WITH {_DOCS}, {_lexical('tfidf', 'docs', 'queries', 5)} SELECT * FROM tfidf_r",
    "fuse_round_robin": f"WITH {_RANKED}, {_fused('ranked', 'rank, retriever_idx, ord', 400)}",
    "fuse_concat": f"""WITH {_RANKED}, once AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY retriever_idx, rank, ord) = 1)
      SELECT query_id, ord, CAST(row_number() OVER (PARTITION BY query_id ORDER BY retriever_idx, rank, ord) AS INTEGER) AS place FROM once QUALIFY place <= 8""",
    "auto_hybrid": f"WITH {_RANKED}, both_ AS (SELECT query_id, 0 AS tier, b.rank, ord, text FROM bm25_r b JOIN v USING (ord) WHERE score >= 70 AND rank <= 2 UNION ALL SELECT query_id, 1, rank, ord, text FROM knn JOIN v USING (ord)), {_fused('both_', 'tier, rank, ord', 500)}",
    "hybrid_search": f"WITH {_RANKED}, both_ AS (SELECT query_id, 0 AS tier, b.rank, ord, text FROM bm25_r b JOIN v USING (ord) WHERE score >= 70 AND rank <= 2 UNION ALL SELECT query_id, 1, rank, ord, text FROM knn JOIN v USING (ord)), {_fused('both_', 'tier, rank, ord', 500)}",
    "references_stub": """WITH k AS (SELECT ord, coalesce(docs, '') AS t, CASE WHEN metadatas['source'] IS NOT NULL AND metadatas['page'] IS NOT NULL THEN metadatas['source'] ELSE metadatas['url'] END AS ref,
        CASE WHEN metadatas['source'] IS NOT NULL AND metadatas['page'] IS NOT NULL THEN metadatas['page'] ELSE metadatas['title'] END AS part FROM dbs),
      g AS (SELECT ref, part, string_agg(t, '' ORDER BY ord) AS t FROM k WHERE ref IS NOT NULL AND part IS NOT NULL GROUP BY ALL),
      h AS (SELECT ref, part, unnest(CASE WHEN """ + _words("t") + """ >= 3000 THEN [t[:length(t) // 2], t[length(t) // 2 + 1:]] ELSE [t] END) AS t FROM g)
      SELECT ref, array_to_string(list(DISTINCT part ORDER BY part), ',') AS parts FROM h WHERE contains(string_split(t, chr(10) || chr(10))[-1], 'chunk') GROUP BY 1""",
    "budget_prefix": f"WITH {_SOURCED}, t AS (SELECT source, doc_id, CAST(sum({_words('text')}) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM d) SELECT * FROM t WHERE total <= 2000",
    "history_window": f"""WITH once AS (SELECT conv_id, turn, lower(role) AS role, coalesce(content, '') AS content FROM history QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY sent_at DESC NULLS LAST, role DESC NULLS LAST, content DESC NULLS LAST) = 1),
      b AS (SELECT *, row_number() OVER w AS n, lead(content) OVER w AS asked, lead(role) OVER w AS asker FROM once WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
      p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS pair, 'Assistant: ' || content AS a, 'User: ' || asked AS q FROM b WHERE n % 2 = 1 AND role = 'assistant' AND asker = 'user' QUALIFY pair <= 3),
      x AS (SELECT conv_id, pair, 0 AS side, a AS text FROM p UNION ALL SELECT conv_id, pair, 1, q FROM p),
      k AS (SELECT *, {_words('text')} AS size FROM x QUALIFY sum({_words('text')}) OVER (PARTITION BY conv_id ORDER BY pair, side ROWS UNBOUNDED PRECEDING) <= 200),
      j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY pair DESC, side DESC) AS history, CAST(sum(size) AS BIGINT) AS n_tokens, count(*) FILTER (side = 1) AS full_ FROM k GROUP BY 1)
      SELECT c.conv_id, CASE WHEN full_ > 0 THEN history ELSE '' END AS history, CASE WHEN full_ > 0 THEN n_tokens ELSE 0 END AS n_tokens FROM (SELECT DISTINCT conv_id FROM history) c LEFT JOIN j USING (conv_id)""",
    "doc_windows": f"WITH {_SOURCED}, w AS (SELECT source, doc_id AS start, list(coalesce(text, '')) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v FROM d) SELECT source, start, md5(array_to_string(v, '|')) AS window_md5 FROM w WHERE len(v) = 3",
    "doc_batches": f"WITH {_SOURCED}, b AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch FROM d) SELECT source, batch, count(*) AS n, min(doc_id) AS first_id FROM b GROUP BY ALL",
    "roles_by_position": f"WITH {_TURNS} SELECT conv_id, md5(array_to_string(list_transform(texts, lambda x, i: CASE WHEN i % 2 = 1 THEN 'user:' ELSE 'assistant:' END || x), '|')) AS messages_md5 FROM t",
    "merge_history": f"WITH {_TURNS} SELECT conv_id, md5(array_to_string(list_transform(texts, lambda x, i: CASE WHEN i % 2 = 1 THEN 'user: ' ELSE 'assistant: ' END || x || chr(10)), '') || chr(10) || chr(10) || 'And then?') AS prompt_md5 FROM t",
    "split_reference": f"""WITH h AS (SELECT doc_id, CASE WHEN {_words('text')} >= 60 THEN [substring(text, 1, length(text) // 2), substring(text, length(text) // 2 + 1)] ELSE [text] END AS p FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL))
      SELECT doc_id, CAST(i - 1 AS INTEGER) AS half, md5(p[i]) AS text_md5 FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM h)""",
    "format_context": f"WITH {_SOURCED} SELECT source, md5(string_agg(coalesce(text, ''), chr(10) || '----------------' || chr(10) ORDER BY doc_id)) AS context_md5 FROM d GROUP BY 1",
    "doc_word_count": f"SELECT doc_id, CAST({_words('text')} AS INTEGER) AS n_words, CAST(coalesce(len({_tokens('text')}), 0) AS INTEGER) AS n_tokens FROM documents",
    "split_model_name": "SELECT run_id, lower(split_part(model, ':', 1)) AS type, CASE WHEN contains(model, ':') THEN regexp_replace(model, '^[^:]*:', '') WHEN model IS NOT NULL THEN '' END AS name FROM handle_table",
    "storage_names": """WITH p AS (SELECT ord, replace(source, '\\', '/') AS path, source, docs FROM dbs)
      SELECT ord, 'chromadb/' || CASE WHEN regexp_matches(path, '^https?://') THEN substring(regexp_replace(path, '[^a-zA-Z0-9]', '', 'g'), 1, 30)
        ELSE coalesce(nullif(array_to_string(list_filter(list_transform(string_split(path, '/'), lambda x: CASE WHEN trim(x) IN ('.', '') THEN '' ELSE regexp_replace(x, '[^a-zA-Z0-9.-]', '', 'g') END), lambda x: x <> ''), '-'), ''), 'NoPaReNtDiR') END || '_openai_text-embed_1000' AS store,
        regexp_matches(source, '^https?://') AS url, md5(docs) AS docs_md5 FROM p""",
    "category_clean": r"SELECT doc_id, coalesce(nullif(rtrim(regexp_replace(concat_ws(': ', category, title), '[^\p{L}\p{N}_ ]', '', 'g'), ' '), ''), 'uncategorized') AS clean FROM documents",
    "answer_digits": r"SELECT run_id, coalesce(round(try_cast(nullif(regexp_extract(response, '[0-9]+\.?[0-9]*'), '') AS DOUBLE), 3), 0.0) AS number, coalesce(CASE WHEN json_valid(response) THEN nullif(json_extract_string(response, '$.ans'), '') END, nullif(regexp_extract(response, '[0-9]'), ''), '-1') AS digit FROM handle_table",
    "language_names": "SELECT doc_id, CASE lower(trim(lang, ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " ELSE 'traditional chinese' END AS language FROM documents",
    "thinking_budgets": "SELECT run_id, CAST(CASE run_id % 4 " + " ".join(f"WHEN {i} THEN greatest({floor}, ceil(length(coalesce(response, '')) * {share}::DOUBLE))" for i, (share, floor) in enumerate(THINKING.values())) + " END AS BIGINT) AS budget FROM handle_table",
    "trace_truncated": "SELECT ord, md5(CASE WHEN length(docs) > 4000 THEN docs[:4000] || chr(10) || '... [verbose output truncated]' ELSE docs END) AS trace_md5 FROM dbs WHERE docs IS NOT NULL",
    "content_blocks": "SELECT run_id, md5(coalesce(response, '')) AS answer_md5, md5(coalesce(prompt, '')) AS thinking_md5 FROM handle_table",
    "prompt_messages": """SELECT run_id, CASE WHEN lower(split_part(model, ':', 1)) IN ('openai', 'remote', 'azure', 'anthropic') THEN 'chat_gpt' WHEN lower(split_part(model, ':', 1)) IN ('gemini', 'google') THEN 'chat_gemini'
        WHEN contains(lower(coalesce(model, '')), 'mistral') THEN 'chat_mistral' WHEN contains(lower(coalesce(model, '')), 'gemma') THEN 'chat_gemma' WHEN contains(lower(coalesce(model, '')), 'llama') THEN 'llama' ELSE 'gpt' END AS style,
      md5('system=Be brief.' || CASE WHEN coalesce(prompt, '') <> '' THEN '|user=' || prompt ELSE '' END) AS chat_md5,
      md5('[INST] <<SYS>> Be brief. <</SYS>> ' || chr(10) || prompt || ' [/INST]') AS llama_md5 FROM handle_table""",
    "run_parameters": "SELECT run_id, CAST((coalesce(model, '') <> '')::INT + (coalesce(lang, '') <> '')::INT AS INTEGER) AS n_parameters, nullif(model, '') AS model, md5(coalesce(nullif(array_to_string(metadata, '; '), ''), 'none')) AS line_md5 FROM handle_table",
    "html_pages": f"SELECT doc_id, CASE WHEN regexp_matches(title, '{_NWS}') THEN regexp_replace(regexp_replace(title, '^{_WS}+', ''), '{_WS}+$', '') ELSE 'No title found' END AS title, md5(concat_ws(' ', nullif({_strip("coalesce(title, '')")}, ''), nullif({_strip("coalesce(text, '')")}, ''))) AS text_md5 FROM documents",
    "header_dates": "SELECT ord, date_trunc('second', created_at) AS modified FROM dbs WHERE created_at IS NOT NULL",
    "question_choices": """SELECT qid, md5(question || CASE WHEN len(choices) > 0 THEN chr(10) || array_to_string(list_transform(choices, lambda c, i: i::VARCHAR || '. ' || c), chr(10)) ELSE '' END) AS text_md5,
      coalesce(try_cast(trim(answer) AS INTEGER) BETWEEN 1 AND len(choices), false) AS valid FROM questions""",
    "single_choice_build": """WITH b AS (SELECT qid, CAST(qid % 4 AS BIGINT) AS r, replace(choices[1], chr(10), '') AS a, list_transform(choices[2:4], lambda c: replace(c, chr(10), '')) AS w FROM questions WHERE choices IS NOT NULL),
      c AS (SELECT qid, r, list_concat(list_concat(w[1:r], [a]), w[r + 1:]) AS l FROM b)
      SELECT qid, array_to_string(list_concat(list_transform(l, lambda x, i: i::VARCHAR || '.' || x), [(r + 1)::VARCHAR]), '|') AS built FROM c""",
    "compare_questions_stub": """WITH i AS (SELECT category, source, min(doc_id) AS place FROM documents WHERE category IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
      SELECT category, 'How do they differ?' AS question, string_agg(source, ', ' ORDER BY place, source) AS answer FROM i GROUP BY 1 HAVING count(*) >= 3""",
    "search_function": f"""WITH s AS (SELECT doc_id AS ord, CAST(len(list_intersect(list_distinct({_tokens('text')}), list_distinct({_tokens("'How does the token counter handle chunks at night?'")}))) AS INTEGER) AS hits FROM documents)
      SELECT ord, hits FROM s WHERE hits > 0 ORDER BY hits DESC, ord LIMIT 20""",
    "lineitem_flags": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL",
    "orders_by_nation": "SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
