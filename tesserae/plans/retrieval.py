"""Queries on text, indexes and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import index, retrieval, sampling
from tesserae.plans.conversation import eval_turns
from tesserae.plans.fragments import BM25, CJK, HYBRID, SLOTS, TEXT, features, tokens
from tesserae.sources.tables import stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Phrases and the code terms they ask for, the reference's whole dictionary in its order and then those of the test corpora.
MAPPING = {
    "ミドルウェア": ["middleware", "Middleware", "BaseHTTPMiddleware"],
    "依存性注入": ["dependency injection", "Depends", "dependencies"],
    "依存性": ["dependency", "Depends", "dependencies"],
    "ルーター": ["router", "APIRouter", "include_router"],
    "エンドポイント": ["endpoint", "route", "path operation"],
    "認証": ["authentication", "auth", "authenticate"],
    "認可": ["authorization", "authorize", "permission"],
    "セキュリティ": ["security", "SecurityScheme", "OAuth2"],
    "バリデーション": ["validation", "validator", "pydantic"],
    "スキーマ": ["schema", "BaseModel", "pydantic"],
    "例外": ["exception", "HTTPException", "error handler", "raise"],
    "エラーハンドラ": ["exception handler", "add_exception_handler"],
    "リクエスト": ["request", "Request"],
    "レスポンス": ["response", "Response", "JSONResponse"],
    "セッション": ["session", "SessionMiddleware"],
    "テスト": ["test", "TestClient", "pytest"],
    "移行": ["migration", "migration plan"],
    "リスク": ["risk", "impact"],
    "影響": ["impact", "affected", "dependency"],
    "キャッシュ": ["cache", "use_cache", "dependency_cache"],
    "デコレータ": ["decorator", "@app.get", "@router"],
    "ライフサイクル": ["lifecycle", "lifespan", "startup", "shutdown"],
    "WebSocket": ["websocket", "WebSocket", "ws"],
    "バックグラウンド": ["background", "BackgroundTasks"],
    "静的ファイル": ["static", "StaticFiles", "mount"],
    "設定": ["config", "Settings", "BaseSettings"],
    "ログ": ["log", "logger", "logging"],
    "ストリーミング": ["streaming", "StreamingResponse", "stream"],
    "実行順序": ["execution order", "order", "stack"],
    "移植": ["migration", "porting", "refactor"],
    "エンコーディング": ["jsonable_encoder", "ENCODERS_BY_TYPE", "encoders"],
    "デッドロック": ["run_in_threadpool", "asyncio", "anyio", "concurrency"],
    "非同期": ["asyncio", "run_in_threadpool", "anyio", "concurrency"],
    "ステータスコード": ["status_code", "routing"],
    "マルチパート": ["UploadFile", "ImmutableMultiDict", "datastructures", "multipart"],
    "フォームデータ": ["UploadFile", "Form", "datastructures"],
    "ファイルアップロード": ["UploadFile", "File", "datastructures"],
    "パスパラメータ": ["path_params", "solve_dependencies", "routing", "Path"],
    "型変換": ["solve_dependencies", "request_path", "routing", "field"],
    "クエリパラメータ": ["query_params", "Query", "Param", "ParamTypes"],
    "デフォルト値": ["Param", "ParamTypes", "Query", "Body", "Form"],
    "独自バリデータ": ["Param", "ParamTypes", "field_validator", "model_validator"],
    "バリデータ": ["Param", "ParamTypes", "field_validator", "model_validator"],
    "サブアプリ": ["mount", "sub_applications", "routing"],
    "サブアプリケーション": ["mount", "sub_applications", "routing"],
    "エラーハンドリング": ["exception_handler", "add_exception_handler", "HTTPException", "exception_handlers"],
    "ハンドリング": ["exception_handler", "add_exception_handler", "handler"],
    "ルーティング": ["routing", "APIRouter", "include_router", "route"],
    "OpenAPI": ["openapi", "get_openapi", "generate_operation_id", "openapi_utils"],
    "openapi": ["openapi", "get_openapi", "generate_operation_id", "openapi_utils"],
    "スキーマ生成": ["get_openapi", "generate_operation_id", "openapi_utils"],
    "セキュリティスキーム": ["SecurityMiddleware", "add_middleware", "TrustedHostMiddleware", "security"],
    "HTTPSリダイレクト": ["HTTPSRedirectMiddleware", "add_middleware", "middleware"],
    "信頼済みホスト": ["TrustedHostMiddleware", "add_middleware", "middleware"],
    "検索": ["retrieve", "search"],
    "引用": ["citation", "cite"],
    "通知": ["notice", "notify"],
    "recovery": ["restore", "replay"],
    "penalty": ["clause", "fine"],
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Questions of the results whose id is divisible by 50: ``query_id, query``."""
    return kept(spark, root, "questions", lambda: _questions(spark, root))


def _questions(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "eval_sessions").select("session_id", F.explode("turns").alias("t")).groupBy("session_id", F.col("t.turn_id").alias("turn_id")).agg(F.min("t.question").alias("query"))
    asked = table(spark, root, "query_results").where("result_id % 50 = 0").select(F.col("result_id").alias("query_id"), "session_id", "turn_id")
    return asked.join(turns, ["session_id", "turn_id"]).where("query is not null").select("query_id", "query")


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """An index table of a table set, built and stored once per application and read by all its queries."""
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _KEPT:
        _KEPT[key] = stored(build(), "zstd")
    return _KEPT[key]


def chunk_tokens(spark: SparkSession, root: str) -> DataFrame:
    return kept(spark, root, "tokens", lambda: index.tokenised(table(spark, root, "chunks"), "chunk_no", index.indexed_text(), "rel_path", "start_line"))


def chunk_terms(spark: SparkSession, root: str) -> DataFrame:
    """Term statistics, of each text's distinct tokens."""
    def build() -> DataFrame:
        tokens = chunk_tokens(spark, root)
        return index.term_statistics(tokens.select(F.explode(F.array_distinct("tokens")).alias("token")), F.lit(tokens.count()))

    return kept(spark, root, "terms", build)


def chunk_lengths(spark: SparkSession, root: str) -> DataFrame:
    return kept(spark, root, "lengths", lambda: chunk_tokens(spark, root).agg(F.count("*").alias("n_texts"), F.avg("dl").alias("avgdl")))


def chunk_vectors(spark: SparkSession, root: str) -> DataFrame:
    return kept(spark, root, "vectors", lambda: index.token_vectors(chunk_tokens(spark, root), "chunk_no").withColumnRenamed("chunk_no", "item_id"))


def chunk_calls(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks")
    return kept(spark, root, "calls", lambda: index.call_edges(chunks, index.definitions(chunks)))


def build_index(spark: SparkSession, root: str) -> None:
    """Build all index tables of a table set, so that searches only read them."""
    for part in (chunk_tokens, chunk_terms, chunk_lengths, chunk_vectors, chunk_calls):
        part(spark, root)


PLACE = ("rel_path", "start_line")


def searched(spark: SparkSession, root: str, asked: DataFrame, k: int, ties: tuple[str, ...] = PLACE) -> DataFrame:
    """The ``k`` chunks of highest score of each query, with their place."""
    return retrieval.bm25_topk(asked, chunk_tokens(spark, root), chunk_terms(spark, root), chunk_lengths(spark, root), "chunk_no", k, ties)


def lexical_top(spark: SparkSession, root: str, k: int) -> DataFrame:
    return searched(spark, root, questions(spark, root), k)


@query(BM25 + """, placed as (
    select query_id, chunk_no, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as rank
    from scores join chunks using (chunk_no))
select query_id, chunk_no, score, rank from placed where rank <= 10""")
def ret_01_bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    return lexical_top(spark, root, 10).select("query_id", "chunk_no", "score", "rank")


@query(BM25 + """, ordered as (select chunk_no, row_number() over (order by rel_path, start_line, chunk_no) as ord from chunks),
every as (select query_id, chunk_no, ord, coalesce(round(score, 6), 0) as score from queries cross join ordered left join scores using (query_id, chunk_no)),
placed as (select *, row_number() over (partition by query_id order by score desc, ord) as rank from every)
select query_id, chunk_no, score, rank from placed where rank <= 10""")
def ret_01_bm25_topk_filled(spark: SparkSession, root: str) -> DataFrame:
    """Zero-score chunks, in corpus order, fill lists shorter than k."""
    asked, chunks = questions(spark, root), table(spark, root, "chunks")
    first = chunks.orderBy("rel_path", "start_line", "chunk_no").limit(10).select("chunk_no", "rel_path", "start_line").collect()
    hits = lexical_top(spark, root, 10)
    filled = retrieval.with_zero_rows(hits.select("query_id", "chunk_no", "score", F.col("rank").cast("bigint").alias("ord")), asked, [(r.chunk_no, 1000 + i) for i, r in enumerate(first)], "chunk_no", 10)
    return retrieval.top_k(filled, 10, ["query_id"], [F.desc("score"), F.asc("ord")]).select("query_id", "chunk_no", "score", "rank")


@query(f"""with toks as (select chunk_no, {tokens(TEXT)} as toks from chunks),
posts as (select distinct chunk_no, token from (select chunk_no, unnest(toks) as token from toks)),
raw as (select token, count(*) as df, ln((select count(*) from chunks) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from posts group by token)
select token, df, round(case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end, 6) as idf from raw""")
def idx_01_term_statistics(spark: SparkSession, root: str) -> DataFrame:
    tokens = stored(index.tokenised(table(spark, root, "chunks"), "chunk_no", index.indexed_text()))
    return index.term_statistics(index.postings_of(tokens, "chunk_no"), F.lit(tokens.count())).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"select doc_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, {tokens('text')} as t from documents)")
def txt_03_bm25_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", T.bm25_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""with turns as (select session_id, t.turn_id as turn_id, min(t.question) as question from (select session_id, unnest(turns) as t from eval_sessions) group by all),
pairs as (select r.result_id, {features('t.question')} as q, {features('r.answer')} as a from query_results r join turns t on t.session_id = r.session_id and t.turn_id = r.turn_id)
select result_id, len(q) as n_question, len(a) as n_answer, round(case when len(q) > 0 and len(a) > 0 then len(list_intersect(q, a)) / len(q) else 0 end, 6) as overlap from pairs""")
def txt_04_05_feature_overlap(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "eval_sessions").select("session_id", F.explode("turns").alias("t")).groupBy("session_id", F.col("t.turn_id").alias("turn_id")).agg(F.min("t.question").alias("question"))
    pairs = table(spark, root, "query_results").join(turns, ["session_id", "turn_id"]).select("result_id", T.text_features(F.col("question")).alias("q"), T.text_features(F.col("answer")).alias("a"))
    return pairs.select("result_id", F.size("q").cast("bigint").alias("n_question"), F.size("a").cast("bigint").alias("n_answer"), F.round(T.overlap(F.col("q"), F.col("a")), 6).alias("overlap"))


@query(r"""select source, language, count(*) as documents from (select source, case when length(text) > 0 and (length(text) - length(regexp_replace(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]', '', 'g'))) / length(text) >= 0.3 then 'ja'
when length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) > 0 and (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) >= 0.5 then 'en' else 'other' end as language from documents) group by all""")
def txt_06_language(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("source", T.language(F.col("text")).alias("language")).groupBy("source", "language").agg(F.count("*").alias("documents"))


@query("""select doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 80), ''), 'document') as slug from documents""")
def txt_02_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query("""with s as (select doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 80), ''), 'document') as slug from documents),
n as (select doc_id, slug, row_number() over (partition by slug order by doc_id) as n from s)
select doc_id, case when n = 1 then slug else slug || '-' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') end as folder from n""")
def src_10_unique_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folder names of collected documents; repeated slugs are numbered in input order."""
    slugs = table(spark, root, "documents").select("doc_id", T.slug(F.col("title")).alias("slug"))
    numbered = sampling.group_ranks(slugs, ["slug"], ["doc_id"]).drop("n").withColumnRenamed("rank", "n")
    return numbered.select("doc_id", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n"))).otherwise(F.col("n").cast("string")))).alias("folder"))


@query(f"""with grams as (select doc_id, unnest(flatten(list_transform(range(2, 9), lambda k: flatten(list_transform(list_filter(regexp_extract_all(text, '{CJK}'), lambda r: length(r) >= k),
    lambda r: list_transform(range(1, length(r) - k + 2), lambda i: substr(r, i::int, k::int))))))) as phrase from documents)
select phrase, count(*) as tf, count(distinct doc_id) as df from grams where not regexp_full_match(phrase, '[ぁ-ゟ]+') group by phrase having df >= 5 and tf >= 10""")
def idx_09_phrase_table(spark: SparkSession, root: str) -> DataFrame:
    return index.phrase_table(table(spark, root, "documents"), "doc_id", F.col("text"))


@query("""select source, count(*) filter (regexp_matches(text, '第\\d+条')) as with_articles, count(*) filter (regexp_matches(text, '(罰則|罰金|懲役|過料)')) as with_penalty,
count(*) filter (regexp_matches(text, '(但し書き|ただし|例外|除く)')) as with_exception from documents group by source""".replace("\\\\", "\\"))
def txt_08_article_flags(spark: SparkSession, root: str) -> DataFrame:
    flags = [F.count_if(F.regexp_like("text", F.lit(p))).alias(n) for n, p in (("with_articles", T.ARTICLE), ("with_penalty", T.PENALTY), ("with_exception", T.EXCEPTION))]
    return table(spark, root, "documents").groupBy("source").agg(*flags)


@query("""select result_id, length(left(regexp_replace(answer, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 2048)) as n_clean, left(regexp_replace(answer, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 40) as opening,
contains(lower(answer), 'thinking process:') or contains(lower(answer), 'here''s a thinking process') or contains(lower(answer), 'analyze the request:') or contains(lower(answer), '<|channel|>thought') as leaks from query_results""")
def txt_09_10_sanitised(spark: SparkSession, root: str) -> DataFrame:
    clean = T.sanitised(F.col("answer"))
    return table(spark, root, "query_results").select("result_id", F.length(clean).cast("bigint").alias("n_clean"), F.left(clean, F.lit(40)).alias("opening"), T.leaks_reasoning(F.col("answer")).alias("leaks"))


@query("""select chunk_no, octet_length(encode(content)) as n_bytes, md5(lower(hex(encode(content)))) as digest from chunks""")
def txt_11_byte_tokens(spark: SparkSession, root: str) -> DataFrame:
    ids = table(spark, root, "chunks").select("chunk_no", T.byte_tokens(F.col("content")).alias("ids"))
    return ids.select("chunk_no", F.size("ids").cast("bigint").alias("n_bytes"), F.md5(F.array_join(F.transform("ids", lambda i: F.lpad(F.lower(F.hex(i.cast("bigint"))), 2, "0")), "")).alias("digest"))


@query()
def txt_01_normalised(spark: SparkSession, root: str) -> DataFrame:
    """NFKC needs Python; checked against a plain version in the tests."""
    return table(spark, root, "documents").select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"))


@query("""with s as (select unnest(range(0, greatest(n, 1), 2100)) as pos, doc_id, n, text from (select doc_id, text, length(text) as n from documents where text is not null))
select doc_id, pos as start_char, least(pos + 2400, n) as end_char, md5(substr(text, pos::int + 1, 2400)) as digest from s where pos = 0 or pos - 2100 + 2400 < n""")
def chk_02_char_windows(spark: SparkSession, root: str) -> DataFrame:
    from tesserae.operators.chunking import char_windows

    return char_windows(table(spark, root, "documents"), "doc_id", "text", 2400, 300).select("doc_id", "start_char", "end_char", F.md5("piece").alias("digest"))


DENSE = """with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0),
scored as (select query_id, e.vec_id as item_id, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as score from q, embeddings e),
placed as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from scored)"""


@query(DENSE + " select query_id, item_id, score, rank from placed where rank <= 10")
def ret_02_dense_topk(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    vectors = table(spark, root, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(asked, vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 10, digits=6)


@query(BM25 + SLOTS.format("posts", "chunk_no", "slots") + """ select chunk_no, slot::bigint as slot, round(n / norm, 6) as x from slots join slots_norm using (chunk_no)""")
def idx_03_hashed_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Default encoder of chunks, its slots that aren't 0."""
    vectors = chunk_vectors(spark, root).select(F.col("item_id").alias("chunk_no"), F.posexplode("vector").alias("slot", "x"))
    return vectors.where("x <> 0").select("chunk_no", F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("x"))


def hybrid(spark: SparkSession, root: str, k: int = 40) -> DataFrame:
    asked = questions(spark, root)
    question_vectors = stored(index.hashed_vectors(asked, "query_id", F.col("query")))
    dense = retrieval.dense_topk(question_vectors, chunk_vectors(spark, root), k, digits=6).select("query_id", F.col("item_id").alias("chunk_no"), "score")
    return retrieval.fuse(lexical_top(spark, root, k), dense, "chunk_no")


@query(HYBRID + """ select query_id, chunk_no, round(lexical_score, 6) as lexical_score, round(dense_score, 6) as dense_score, score, rank from fused where rank <= 20""")
def ret_05_hybrid_fusion(spark: SparkSession, root: str) -> DataFrame:
    """Lexical and vector lists, each max-normalised, in one outer union; the best 20."""
    fused = hybrid(spark, root).withColumn("score", F.round("score", 6))
    best = retrieval.top_k(fused, 20, ["query_id"], [F.desc("score"), F.asc("chunk_no")])
    return best.select("query_id", "chunk_no", F.round("lexical_score", 6).alias("lexical_score"), F.round("dense_score", 6).alias("dense_score"), "score", "rank")


@query(BM25 + """, placed as (select query_id, chunk_no, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as rank from scores join chunks using (chunk_no))
select query_id, repo_id, count(*) as kept, round(max(score), 6) as best from placed join chunks using (chunk_no) where rank <= 40 and starts_with(chunk_id, 'harbor') group by all""")
def ret_04_repository_filter(spark: SparkSession, root: str) -> DataFrame:
    """Results outside the wanted repositories go after the top k, so fewer than k may be left."""
    top = lexical_top(spark, root, 40).select("query_id", "chunk_no", "score")
    chunks = table(spark, root, "chunks").where(F.startswith("chunk_id", F.lit("harbor"))).select("chunk_no", "repo_id")
    return top.join(chunks, "chunk_no").groupBy("query_id", "repo_id").agg(F.count("*").alias("kept"), F.round(F.max("score"), 6).alias("best"))


@query()
def ret_06_variants(spark: SparkSession, root: str) -> DataFrame:
    """The question and its expansion searched together; of a chunk found twice the better row stays."""
    asked = questions(spark, root)
    expanded = asked.withColumn("query", F.concat_ws(" ", "query", retrieval.expanded_query(F.col("query"), MAPPING)))
    both = asked.withColumn("variant", F.lit(0)).unionByName(expanded.withColumn("variant", F.lit(1)))
    both = both.withColumn("query_id", F.col("query_id") * 2 + F.col("variant"))
    rows = searched(spark, root, both, 40, ()).select(F.floor(F.col("query_id") / 2).alias("query_id"), F.pmod("query_id", F.lit(2)).alias("variant"), "chunk_no", "score")
    return retrieval.top_k(retrieval.merge_variants(rows, "chunk_no"), 10, ["query_id"], [F.desc("score"), F.asc("chunk_no")])


@query()
def ret_07_query_expansion(spark: SparkSession, root: str) -> DataFrame:
    """The expansion of every question of the eval sessions; empty where nothing is mapped or named."""
    return eval_turns(spark, root).where("question is not null").select("session_id", "turn_id", retrieval.expanded_query(F.col("question"), MAPPING).alias("expansion"))


NEIGHBOURS = """with o as (select chunk_no, repo_id, repo_commit, rel_path, row_number() over (partition by repo_id, repo_commit, rel_path order by start_line, chunk_no) as rn from chunks)"""


@query(NEIGHBOURS + """ select a.chunk_no as seed, b.chunk_no, b.rn - a.rn as distance from o a join o b using (repo_id, repo_commit, rel_path) where a.rn <> b.rn and abs(a.rn - b.rn) <= 2""")
def ret_15_file_neighbours(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks")
    seeds = chunks.select(F.lit(0).cast("bigint").alias("query_id"), "chunk_no")
    return retrieval.file_neighbours(seeds, chunks, 2, 2).select("seed", "chunk_no", F.col("distance").cast("bigint").alias("distance"))


@query("""select repo_id, section_header, count(*) as chunks, min(chunk_no) as first_chunk from chunks
where language = 'markdown' and section_header <> '' and len(string_split(section_header, ' > ')) <= 10 and len(list_filter(string_split(section_header, ' > '), lambda p: length(p) between 1 and 500)) = len(string_split(section_header, ' > '))
group by all""")
def idx_06_heading_index(spark: SparkSession, root: str) -> DataFrame:
    return index.headings(table(spark, root, "chunks")).groupBy("repo_id", "section_header").agg(F.count("*").alias("chunks"), F.min("chunk_no").alias("first_chunk"))


@query(BM25 + """, top as (select * from (select query_id, chunk_no, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as k from scores join chunks using (chunk_no)) where k <= 10),
h as (select repo_id, repo_commit, section_header, chunk_no, string_split(section_header, ' > ') as parts from chunks where language = 'markdown' and section_header <> '' and len(string_split(section_header, ' > ')) <= 10 and len(list_filter(string_split(section_header, ' > '), lambda p: length(p) between 1 and 500)) = len(string_split(section_header, ' > '))),
own as (select t.query_id, h.* from top t join h using (chunk_no)),
wanted as (select query_id, chunk_no as seed, repo_id, repo_commit, section_header, 1 as kind from own union all select query_id, chunk_no, repo_id, repo_commit, array_to_string(parts[1:len(parts) - 1], ' > '), 0 from own where len(parts) > 1)
select w.query_id, w.kind, count(distinct h.chunk_no) as chunks from wanted w join h using (repo_id, repo_commit, section_header) where h.chunk_no <> w.seed group by all""")
def ret_14_heading_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours of each question's best chunks in the heading tree."""
    headed = index.headings(table(spark, root, "chunks"))
    seeds = lexical_top(spark, root, 10).select("query_id", "chunk_no")
    return retrieval.heading_neighbours(seeds, headed).groupBy("query_id", "kind").agg(F.countDistinct("chunk_no").alias("chunks"))


@query("""select symbol, count(distinct chunk_no) as chunks, count(distinct repo_id) as repos from (select chunk_no, repo_id, unnest(symbols) as symbol from chunks) group by symbol""")
def idx_04_symbol_definitions(spark: SparkSession, root: str) -> DataFrame:
    return index.definitions(table(spark, root, "chunks")).groupBy("symbol").agg(F.countDistinct("chunk_no").alias("chunks"), F.countDistinct("repo_id").alias("repos"))


@query()
def idx_05_call_edges(spark: SparkSession, root: str) -> DataFrame:
    """Calls between chunks of one repository."""
    chunks = table(spark, root, "chunks")
    return index.call_edges(chunks, index.definitions(chunks))


@query()
def ret_13_symbol_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.symbol_neighbours(stored(lexical_top(spark, root, 10).select("query_id", "chunk_no")), chunk_calls(spark, root), 2)


@query()
def ret_16_17_evidence_pack(spark: SparkSession, root: str) -> DataFrame:
    """Retrieved chunks, their call and file neighbours, then the pack within the budget."""
    chunks = table(spark, root, "chunks")
    fused = retrieval.top_k(hybrid(spark, root).withColumn("score", F.round("score", 6)), 12, ["query_id"], [F.desc("score"), F.asc("chunk_no")])
    fused = stored(fused.select("query_id", "chunk_no", F.col("rank").alias("ord")))
    graph = retrieval.symbol_neighbours(fused, chunk_calls(spark, root), 1).select("query_id", "chunk_no", F.col("hop").alias("ord"))
    near = retrieval.file_neighbours(fused.select("query_id", "chunk_no"), chunks).select("query_id", "chunk_no", F.abs("distance").alias("ord"))
    expanded = retrieval.expand(fused, graph, near)
    sized = expanded.join(chunks.select("chunk_no", F.length("content").alias("chars")), "chunk_no")
    return retrieval.evidence_pack(sized.withColumn("pinned", F.lit(False)).withColumn("recent", F.col("source") == "graph"))


@query(BM25 + f""", top as (select * from (select query_id, chunk_no, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as k from scores join chunks using (chunk_no)) where k <= 40),
pool as (select t.query_id, t.chunk_no, t.score, {' or '.join(f"contains(c.rel_path, '{n}')" for n in retrieval.NOISE)} as noise, {features('q.query')} as qf, {features("concat('Document path: ', rel_path, chr(10), 'Section: ', coalesce(section_header, ''), chr(10), 'Content: ', left(content, 600))")} as pf from top t join chunks c using (chunk_no) join queries q using (query_id)),
clean as (select *, count(*) filter (not noise) over (partition by query_id) as n_clean from pool),
r as (select query_id, chunk_no, score, round(case when len(qf) > 0 and len(pf) > 0 then len(list_intersect(qf, pf)) / len(qf) else 0 end, 6) as reranker_score from clean where not noise or n_clean = 0),
p as (select *, row_number() over (partition by query_id order by reranker_score desc, score desc, chunk_no) as rank from r) select query_id, chunk_no, reranker_score, score, rank from p where rank <= 8""")
def ret_10_rerank_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Reranking with the default scorer, the share of the question's features found in the passage."""
    chunks, asked = table(spark, root, "chunks"), questions(spark, root)
    top = lexical_top(spark, root, 40).select("query_id", "chunk_no", "score").join(asked, "query_id")
    passage = F.concat_ws("\n", F.concat(F.lit("Document path: "), "rel_path"), F.concat(F.lit("Section: "), F.coalesce("section_header", F.lit(""))), F.concat(F.lit("Content: "), F.left("content", F.lit(600))))
    top = top.join(chunks.select("chunk_no", "rel_path", passage.alias("passage")), "chunk_no")
    scorer = F.round(T.overlap(T.text_features(F.col("query")), T.text_features(F.col("passage"))), 6)
    scored = retrieval.without_noise(top.select("query_id", "chunk_no", "score", "rel_path", scorer.alias("overlap")))
    return retrieval.rerank(scored, F.col("overlap")).select("query_id", "chunk_no", "reranker_score", F.round("score", 6).alias("score"), "rank")
