"""The registered queries of the library: each operator on a driver table, with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chunks, language, pii, quality, text
from .functions.tokens import Ranked
from .functions.values import RID
from .operators import augment, fuzzy, ops, reports, shaping
from .plans.executor import run, sample
from .plans.tables import bounded_batches, shared_folder, spread
from .sources import parsers, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A driver table with its key as the row id."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages", "conversations"):  # long texts: work for every core
        df = spread(df)
    return df.withColumn(RID, F.col(key).cast("bigint")) if key else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def plan(df: DataFrame, *steps: ops.Op, **context) -> DataFrame:
    return run(df, steps, context=ops.Context(**context), measure=False).output


# -- pieces of SQL -----------------------------------------------------------------------------------------------

S = r"\p{Z}\t-\r\x{85}"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def sql_normal(x: str) -> str:
    y = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{00AD}}\\x{{180E}}]', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '\\r\\n?', chr(10), 'g')"
    return f"CASE WHEN {x} <> '' AND {sql_trim(y)} = '' THEN NULL ELSE {sql_trim(y)} END"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"


def sql_tokens(x: str) -> str:
    wide, spaces, letters = sql_count(x, f"[{CJK}]"), sql_count(x, r"[ \t\n\r]"), sql_count(x, r"[\p{L}\p{Nl}]")
    total = f"(({letters} - {wide}) / 4.0::DOUBLE + {spaces} * 0.08::DOUBLE + {wide} + (length({x}) - {spaces} - {letters}) / 2.0::DOUBLE)"
    return f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE greatest(1, floor({total} + 0.5::DOUBLE))::BIGINT END"


def sql_language(x: str, source: str) -> str:
    """A query for doc_id, code, confidence of Latin text; tables without other scripts."""
    scores = ", ".join(f"len(list_filter(w, lambda x: list_contains(string_split('{words}', ' '), x)))::DOUBLE / nullif(len(w), 0)" for words in language.STOP_WORDS.values())
    codes = ", ".join(f"'{c}'" for c in language.STOP_WORDS)
    return f"""
      SELECT doc_id, CASE WHEN latin = 0 OR len(w) < 3 OR best <= 0.03::DOUBLE THEN 'und' ELSE [{codes}][list_position(s, best)] END AS code,
        CASE WHEN latin = 0 THEN 0.0::DOUBLE WHEN len(w) < 3 OR best <= 0.03::DOUBLE THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, best * 3 + (best - second) * 2) END AS confidence
      FROM (SELECT *, list_reverse_sort(s)[1] AS best, list_reverse_sort(s)[2] AS second
        FROM (SELECT *, [{scores}] AS s FROM (SELECT doc_id, {sql_words(f"substr({x}, 1, 4000)")} AS w, {sql_count(f"substr({x}, 1, 4000)", "[A-Za-zÀ-ɏ]")} AS latin FROM {source})))"""


def sql_reasons(x: str, source: str) -> str:
    """A query for all columns of the source and reasons (names only) by the standard rules."""
    danglers = ", ".join(f"'{w}'" for w in quality.DANGLERS.split())
    return f"""
      SELECT * EXCLUDE (t, words, lines, signs, letters, digits, uppers), CASE WHEN t = '' THEN ['empty'] ELSE list_filter([
        CASE WHEN len(words) < 3 THEN 'too_few_words' END,
        CASE WHEN len(words) > 100000 THEN 'too_many_words' END,
        CASE WHEN list_sum(list_transform(words, lambda w: length(w))) / len(words)::DOUBLE < 2.0 THEN 'mean_word_length_low' END,
        CASE WHEN list_sum(list_transform(words, lambda w: length(w))) / len(words)::DOUBLE > 12.0 THEN 'mean_word_length_high' END,
        CASE WHEN (signs - letters - digits) / signs::DOUBLE > 0.3::DOUBLE THEN 'symbol_ratio' END,
        CASE WHEN digits / signs::DOUBLE > 0.5::DOUBLE THEN 'digit_ratio' END,
        CASE WHEN letters / signs::DOUBLE < 0.5::DOUBLE THEN 'alpha_ratio_low' END,
        CASE WHEN letters > 20 AND uppers / letters::DOUBLE > 0.6::DOUBLE THEN 'uppercase_ratio' END,
        CASE WHEN len(lines) >= 4 AND 1.0::DOUBLE - len(list_distinct(lines)) / len(lines)::DOUBLE > 0.4::DOUBLE THEN 'duplicate_lines' END,
        CASE WHEN len(words) >= 20 AND list_max(map_values(list_histogram(list_transform(list_zip(words[:-2], words[2:]), lambda z: lower(z[1]) || ' ' || lower(z[2]))))) / (len(words) - 1)::DOUBLE > 0.25::DOUBLE THEN 'repetitive_bigram' END,
        CASE WHEN len(words) >= 10 AND (lower(words[-1]) IN ({danglers}) OR ends_with(t, '...') OR ends_with(t, '…') OR ends_with(t, ',') OR ends_with(t, '-')) THEN 'truncated_ending' END
      ], lambda r: r IS NOT NULL) END AS reasons
      FROM (SELECT *, list_filter(regexp_split_to_array(t, '[ \\n\\t]+'), lambda w: w <> '') AS words,
          list_filter(list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^[\\p{{Zs}}\\t]+|[\\p{{Zs}}\\t]+$', '', 'g')), lambda l: l <> '') AS lines,
          {sql_count("t", r"[^\s\p{Z}\x{85}]")} AS signs, {sql_count("t", r"[\p{L}\p{M}]")} AS letters, {sql_count("t", r"\p{N}")} AS digits, {sql_count("t", r"\p{Lu}")} AS uppers
        FROM (SELECT *, {sql_trim(f"coalesce({x}, '')")} AS t FROM {source}))"""


# -- structure and expressions -------------------------------------------------------------------------------------


@query("select_columns", "SELECT n_name, n_nationkey FROM nation")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "nation", "n_nationkey"), ops.SelectColumns(("n_name", "absent", "n_nationkey")))


@query("drop_columns", "SELECT * EXCLUDE (s_acctbal) FROM supplier")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "supplier", "s_suppkey"), ops.DropColumns(("s_acctbal", "absent")))


@query("rename_column", "SELECT r_regionkey AS region_id, r_name FROM region")
def rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "region", "r_regionkey"), ops.RenameColumn("r_regionkey", "region_id"))


LINES = "l_orderkey, l_linenumber"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn(RID, F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query("add_column", f"SELECT {LINES}, l_extendedprice * (1 - l_discount) AS revenue, NULL::VARCHAR AS nothing FROM lineitem")
def add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(lines(spark, sf_dir), ops.AddColumn("revenue", "l_extendedprice * (1 - l_discount)"), ops.AddColumn("nothing", "absent + 1"), ops.SelectColumns(("l_orderkey", "l_linenumber", "revenue", "nothing")))


@query("filter_rows", f"SELECT {LINES}, l_quantity FROM lineitem WHERE l_quantity >= 30 AND (l_returnflag = 'R' OR NOT l_linestatus = 'O')")
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(lines(spark, sf_dir), ops.FilterRows("l_quantity >= 30 and (l_returnflag == 'R' or not l_linestatus == 'O')"), ops.SelectColumns(("l_orderkey", "l_linenumber", "l_quantity")))


def computed(df: DataFrame, key: tuple[str, ...], **made: str) -> DataFrame:
    return plan(df, *[ops.AddColumn(k, e) for k, e in made.items()], ops.SelectColumns((*key, *made)))


@query("expr_strings", "SELECT p_partkey, length(p_name)::BIGINT AS n, upper(p_brand) AS up, lower(p_type) AS low, contains(p_name, 'a') AS has_a, starts_with(p_type, 'P') AS starts, ends_with(p_type, 'L') AS ends, replace(p_brand, '#', '-') AS brand, substr(p_name, 3, 4) AS part, p_brand || '/' || p_size AS both, trim('  x ' || p_brand || ' ') AS trimmed FROM part")
def expr_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return computed(table(spark, sf_dir, "part", "p_partkey"), ("p_partkey",), n="len(p_name)", up="upper(p_brand)", low="lower(p_type)", has_a="contains(p_name, 'a')", starts="starts_with(p_type, 'P')", ends="ends_with(p_type, 'L')", brand="replace(p_brand, '#', '-')", part="substr(p_name, 2, 4)", both="concat(p_brand, '/', p_size)", trimmed="trim('  x ' + p_brand + ' ')")


@query("expr_math", "SELECT o_orderkey, o_custkey % 7 AS r, o_totalprice / nullif(o_custkey % 3, 0) AS share, round(o_totalprice)::BIGINT AS whole, abs(5 - o_custkey) AS away, least(o_totalprice, 1000.0::DOUBLE) AS low, greatest(o_custkey::DOUBLE, 50.0::DOUBLE) AS high, -o_totalprice AS neg, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders")
def expr_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return computed(table(spark, sf_dir, "orders", "o_orderkey"), ("o_orderkey",), r="o_custkey % 7", share="o_totalprice / (o_custkey % 3)", whole="round(o_totalprice)", away="abs(5 - o_custkey)", low="min(o_totalprice, 1000)", high="max(o_custkey, 50)", neg="-o_totalprice", size="if(o_totalprice > 100000, 'big', 'small')")


@query("expr_nulls", "SELECT c_custkey, c_acctbal IS NULL AS missing, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS label, c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AS same, c_acctbal <> 0 AND c_nationkey > 3 AS ok FROM customer")
def expr_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return computed(table(spark, sf_dir, "customer", "c_custkey"), ("c_custkey",), missing="is_null(c_acctbal)", label="coalesce(if(c_mktsegment == 'BUILDING', null, c_mktsegment), c_name)", same="c_mktsegment == 'BUILDING'", ok="c_acctbal and c_nationkey > 3")


# -- cleaning and types ----------------------------------------------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {sql_normal('text')} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.NormalizeText(("text",)), ops.SelectColumns(("doc_id", "text")))


_tags = "html"
for _pattern, _instead in text.TAG_STEPS:
    _tags = f"regexp_replace({_tags}, '{_pattern}', '{_instead}', 'g')"
_tags = sql_trim(_tags)


@query("strip_html", f"SELECT page_id, {_tags} AS text FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("normalize_aggressive")
def normalize_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "pages", "page_id"), ops.NormalizeText(("html",), text.AGGRESSIVE), ops.SelectColumns(("page_id", "html")))


_messy = "CASE event_id % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'null' WHEN 2 THEN '1,234' WHEN 3 THEN '12.5' WHEN 4 THEN 'Yes' WHEN 5 THEN '50%' ELSE event_type END"
_nulls = "'', 'na', 'n/a', 'nan', 'null', 'none', 'nil', '-', '--', '?', 'missing', '#n/a', '#null!', '(null)', 'undefined'"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id").select(RID, "event_id", F.expr(_messy).alias("cell"))


@query("unify_nulls", f"SELECT event_id, CASE WHEN lower(trim(cell)) IN ({_nulls}) THEN NULL ELSE cell END AS cell FROM (SELECT event_id, {_messy} AS cell FROM events)")
def unify_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(messy(spark, sf_dir), ops.UnifyNulls(("cell",)))


def _coerced(name: str, sql: str) -> None:
    @query(f"coerce_{name}", f"SELECT event_id, {sql} AS cell FROM (SELECT event_id, {_messy} AS cell FROM events)")
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(messy(spark, sf_dir), ops.CoerceType("cell", name))


_coerced("int", "CASE WHEN event_id % 7 = 2 THEN 1234::BIGINT END")
_coerced("double", "CASE event_id % 7 WHEN 2 THEN 1234.0::DOUBLE WHEN 3 THEN 12.5::DOUBLE WHEN 5 THEN 0.5::DOUBLE END")
_coerced("bool", "CASE WHEN event_id % 7 = 4 THEN true END")
_coerced("string", f"CASE WHEN lower(trim(cell)) IN ({_nulls}) THEN NULL ELSE cell END")


@query("coerce_date", "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%dT00:00:00Z') AS day FROM orders")
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders", "o_orderkey").select(RID, "o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    out = plan(given, ops.CoerceType("day", "date"))
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("day"))


@query("auto_type", "SELECT o_orderkey, o_custkey AS whole, o_totalprice AS price, o_orderstatus AS status FROM orders")
def auto_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders", "o_orderkey").select(RID, "o_orderkey", F.col("o_custkey").cast("string").alias("whole"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("status"))
    return plan(given, ops.AutoType())


# -- duplicates ------------------------------------------------------------------------------------------------------


@query("dedupe_exact", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.DedupeExact(("text",)), ops.SelectColumns(("doc_id", "text")))


@query("dedupe_exact_columns", "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY ALL")
def dedupe_exact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "orders", "o_orderkey"), ops.DedupeExact(("o_custkey", "o_orderstatus")), ops.SelectColumns(("o_orderkey", "o_custkey", "o_orderstatus")))


_grams = "list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
_fuzzy = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_grams} AS g FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)),
c AS (SELECT min(doc_id) AS rep, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM d) GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS gram FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.gram = b.gram AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.85::DOUBLE * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node)
SELECT node AS doc_id FROM r GROUP BY node HAVING min(seen) = node"""


@query("dedupe_fuzzy", _fuzzy)
def dedupe_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.DedupeFuzzy("text", 0.85), ops.SelectColumns(("doc_id",)))


@query("simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def mark(values):
        return values.fillna("").map(lambda x: f"{fuzzy.simhash(x):016x}")

    bounded_batches(spark)
    return documents(spark, sf_dir).select("doc_id", mark("text").alias("simhash"))


# -- personal data ---------------------------------------------------------------------------------------------------


@query("pii_email", f"SELECT doc_id, regexp_replace(text, '{pii.PATTERNS['email']}', '[EMAIL]', 'g') AS text FROM documents")
def pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.RedactPII(("text",), ("email",)), ops.SelectColumns(("doc_id", "text")))


@query("pii_remove_email", f"SELECT doc_id, regexp_replace(text, '{pii.PATTERNS['email']}', '', 'g') AS text FROM documents")
def pii_remove_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.RedactPII(("text",), ("email",), "remove"), ops.SelectColumns(("doc_id", "text")))


#: Keys and addresses built from row numbers, in words that hold no digit but those of the address.
_secrets = "CASE o_orderkey % 4 WHEN 0 THEN 'key AKIA' || translate(lpad(o_orderkey::VARCHAR, 16, '0'), '0123456789', 'ABCDEFGHIJ') || ' here' WHEN 1 THEN 'ip abcd:ef:abcd:ef:abcd end' WHEN 2 THEN 'host 10.' || o_orderkey % 200 || '.0.1, local 127.0.0.1' ELSE o_orderpriority END"
_hidden = "CASE o_orderkey % 4 WHEN 0 THEN 'key [APIKEY] here' WHEN 1 THEN 'ip [IPADDRESS] end' WHEN 2 THEN 'host [IPADDRESS], local 127.0.0.1' ELSE o_orderpriority END"


@query("pii_keys", f"SELECT o_orderkey, {_hidden} AS note FROM orders")
def pii_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders", "o_orderkey").select(RID, "o_orderkey", F.expr(_secrets.replace("::VARCHAR", "::STRING")).alias("note"))
    return plan(given, ops.RedactPII(("note",), ("apiKey", "ipAddress")))


@query("pii_all")
def pii_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.RedactPII(("text",), mode="hash"), ops.SelectColumns(("doc_id", "text")))


# -- quality, language, contamination, tokens ------------------------------------------------------------------------------


@query("quality_filter", f"SELECT doc_id FROM ({sql_reasons('text', 'documents')}) WHERE len(reasons) = 0")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.QualityFilter("text"), ops.SelectColumns(("doc_id",)))


@query("quality_reasons", f"SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM ({sql_reasons('text', 'documents')})")
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(quality.reasons(F.col("text")), quality.reason_name)
    return documents(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("reasons"))


@query("quality_score", f"SELECT doc_id, CASE WHEN reasons = ['empty'] THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - len(reasons) * 0.25::DOUBLE) END AS quality_score FROM ({sql_reasons('text', 'documents')})")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.AddQualityScore("text"), ops.SelectColumns(("doc_id", "quality_score")))


@query("language", f"SELECT doc_id, code AS detected FROM ({sql_language('text', 'documents')})")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir).drop("lang"), ops.AddLanguage("text"), ops.RenameColumn("lang", "detected"), ops.SelectColumns(("doc_id", "detected")))


@query("language_filter", f"SELECT doc_id FROM ({sql_language('text', 'documents')}) WHERE code IN ('en', 'de') AND confidence >= 0.2::DOUBLE")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.LanguageFilter("text", ("en", "de"), 0.2), ops.SelectColumns(("doc_id",)))


_eight = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))"


@query("decontaminate", f"WITH g AS (SELECT DISTINCT unnest({_eight}) AS gram FROM (SELECT {sql_words('text')} AS w FROM benchmark) WHERE len(w) >= 8), d AS (SELECT doc_id, unnest({_eight}) AS gram FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents) WHERE len(w) >= 8) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d JOIN g USING (gram))")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.decontaminated(documents(spark, sf_dir), "text", table(spark, sf_dir, "benchmark"), 8).select("doc_id")


@query("token_count", f"SELECT doc_id, {sql_tokens('text')} AS token_count FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.AddTokenCount("text"), ops.SelectColumns(("doc_id", "token_count")))


@query("token_count_bpe")
def token_count_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a vocabulary file; here a public one stands for the caller's."""
    import public_tokenizers

    bpe = Ranked(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return plan(documents(spark, sf_dir), ops.AddTokenCount("text"), ops.SelectColumns(("doc_id", "token_count")), tokenizer=bpe)


@query("chunk_text")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.ChunkText("text", chunks.ChunkerConfig(target_tokens=128, overlap_tokens=16)))


@query("split", "SELECT doc_id, CASE WHEN r <= round(0.8 * n) THEN 'train' WHEN r <= round(0.8 * n) + round(0.1 * n) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir), ops.Split(0.8, 0.1, 0.1, 7), ops.SelectColumns(("doc_id", "split")))


@query("split_stratified", "SELECT o_orderkey, o_orderstatus, CASE WHEN r <= round(0.9 * n) THEN 'train' WHEN r <= round(0.9 * n) + round(0.05 * n) THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "orders", "o_orderkey"), ops.Split(stratify_by="o_orderstatus"), ops.SelectColumns(("o_orderkey", "o_orderstatus", "split")))


# -- augmentation ------------------------------------------------------------------------------------------------------------


def _augment(spark: SparkSession, sf_dir: str, kind: str, labels: tuple[str, ...] = ()) -> DataFrame:
    config = augment.AugmentConfig(kind, "text", labels=labels)
    return plan(documents(spark, sf_dir), ops.Augment(config), ops.SelectColumns(("doc_id", *augment.OUTPUTS[kind])), client=augment.DemoClient())


_judge = r"list_filter(regexp_split_to_array(text, '[\s\p{Z}\x{85}]+'), lambda w: w <> '')"


@query("augment_judge", rf"SELECT doc_id, (4 + (len(w) >= 12)::INT + (len(w) >= 40)::INT + (len(list_filter(regexp_split_to_array(text, '[.!?\n]'), lambda s: {sql_trim('s')} <> '')) >= 2)::INT + (len(w) > 0 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1)::DOUBLE >= 0.6::DOUBLE)::INT + regexp_matches(text, '\p{{N}}')::INT)::BIGINT AS judge_score FROM (SELECT doc_id, substr(text, 1, 24000) AS text, {_judge.replace('(text,', '(substr(text, 1, 24000),')} AS w FROM documents)")
def augment_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _augment(spark, sf_dir, "judgeScore").drop("judge_rationale")


@query("augment_qa")
def augment_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _augment(spark, sf_dir, "generateQA")


@query("augment_rewrite")
def augment_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _augment(spark, sf_dir, "rewrite")


@query("augment_classify", "SELECT doc_id, CASE WHEN contains(t, 'e') THEN 'e' WHEN contains(t, 'a') THEN 'a' END AS label FROM (SELECT doc_id, lower(substr(text, 1, 24000)) AS t FROM documents) WHERE contains(t, 'e') OR contains(t, 'a')")
def augment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.substring("text", 1, 24000))
    return _augment(spark, sf_dir, "classify", ("e", "a")).join(documents(spark, sf_dir).where(F.contains(low, F.lit("e")) | F.contains(low, F.lit("a"))).select("doc_id"), "doc_id", "left_semi")


@query("augment_preference")
def augment_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _augment(spark, sf_dir, "preferencePair")


# -- files: a table written in a format and read again ----------------------------------------------------------------------------


def stored(df: DataFrame, kind: str) -> str:
    where = shared_folder(df.sparkSession)
    writers.write(df, where, kind)
    return where


def _text_of(*names: str) -> str:
    return ", ".join(f"{c}::VARCHAR AS {c}" for c in names)


@query("io_csv_file", f"SELECT {_text_of('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment')} FROM customer")
def io_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single file: separator, header and names are guessed, cells stay text."""
    found = parsers.read_delimited(writers.to_text(table(spark, sf_dir, "customer", "c_custkey"), "csv"))
    return readers.from_table(spark, found).drop(RID)


@query("io_tsv_scan", f"SELECT {_text_of('s_suppkey', 's_name', 's_nationkey', 's_acctbal')} FROM supplier")
def io_tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_delimited(spark, stored(table(spark, sf_dir, "supplier", "s_suppkey"), "tsv"), delimiter="\t", header=True).drop(RID)


@query("io_csv_scan", "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text FROM documents")
def io_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, separators and line ends, written and read in parallel."""
    return readers.scan_delimited(spark, stored(documents(spark, sf_dir).select(RID, "doc_id", "text"), "csv"), delimiter=",", header=True).drop(RID)


@query("io_jsonl_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def io_jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_json_lines(spark, stored(table(spark, sf_dir, "orders", "o_orderkey").drop("o_orderdate"), "jsonl")).drop(RID)


@query("io_json_file", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of objects as one text, told by its first sign; whole numbers keep their type."""
    found = parsers.read_json(writers.to_text(table(spark, sf_dir, "nation", "n_nationkey"), "json"))
    return readers.from_table(spark, found).drop(RID)


@query("io_parquet", "SELECT * FROM part")
def io_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.numbered(spark.read.parquet(stored(table(spark, sf_dir, "part", "p_partkey"), "parquet"))).drop(RID)


# -- shaping -------------------------------------------------------------------------------------------------------------------

_turns = "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS s, arg_min(text, turn) FILTER (WHERE role = 'user') AS u, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def first(role: str) -> F.Column:
        mine = F.col("role") == role
        return F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn")))

    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("system").alias("system"), first("user").alias("user"), first("assistant").alias("assistant"))
    return rows.withColumn(RID, F.col("conv_id").cast("bigint"))


def _message(role: str, cell: str) -> str:
    return f"{{'content': {cell}, 'role': '{role}'}}"


_u, _a, _s = _message("user", "u"), _message("assistant", "a"), _message("system", "s")
_ok = "WHERE coalesce(u, '') <> '' AND coalesce(a, '') <> ''"
SHAPES = {
    "alpaca": ({"instruction": "user", "output": "assistant", "input": "system"}, "to_json({'input': coalesce(s, ''), 'instruction': u, 'output': a})", _ok),
    "openaiMessages": (None, f"to_json({{'messages': CASE WHEN coalesce(s, '') <> '' THEN [{_s}, {_u}, {_a}] ELSE [{_u}, {_a}] END}})", _ok),
    "anthropicTurns": (None, f"CASE WHEN coalesce(s, '') <> '' THEN to_json({{'messages': [{_u}, {_a}], 'system': s}}) ELSE to_json({{'messages': [{_u}, {_a}]}}) END", _ok),
    "chatml": (None, "to_json({'text': CASE WHEN coalesce(s, '') <> '' THEN '<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>'})", _ok),
    "dpo": ({"prompt": "system", "chosen": "user", "rejected": "assistant"}, "to_json({'chosen': u, 'prompt': s, 'rejected': a})", f"{_ok} AND coalesce(s, '') <> '' AND u <> a"),
    "completion": ({"prompt": "user", "completion": "assistant"}, "to_json({'completion': a, 'prompt': u})", _ok),
    "corpus": ({"text": "user"}, "to_json({'text': u})", "WHERE coalesce(u, '') <> ''"),
    "ragChunks": ({"text": "user", "source": "system"}, "to_json({'id': conv_id, 'metadata': json_merge_patch(to_json(CASE WHEN a IS NULL THEN NULL ELSE {'assistant': a} END), to_json(CASE WHEN s IS NULL THEN {'conv_id': conv_id} END), to_json(CASE WHEN s IS NOT NULL THEN {'conv_id': conv_id, 'source': s} END)), 'text': u})", "WHERE coalesce(u, '') <> ''"),
}


def _shape(schema: str, mapping: dict[str, str] | None, record: str, where: str) -> None:
    # the last schema's optional members are compared by rows alone
    @query(f"shape_{schema}", None if schema == "ragChunks" else f"SELECT conv_id, {record}::VARCHAR AS record FROM ({_turns}) {where}")
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = turns(spark, sf_dir)
        out = shaping.shape(df, schema, mapping or {k: k for k in ("system", "user", "assistant")})
        return out.valid.select(F.col(RID).alias("conv_id"), F.col("json").alias("record"))


for _name, (_mapping, _record, _where) in SHAPES.items():
    _shape(_name, _mapping, _record, _where)


@query("shape_quarantine", f"SELECT conv_id, 'missing: ' || array_to_string(list_filter([CASE WHEN coalesce(s, '') = '' THEN 'prompt' END, CASE WHEN coalesce(u, '') = '' THEN 'chosen' END, CASE WHEN coalesce(a, '') = '' THEN 'rejected' END], lambda x: x IS NOT NULL), ', ') AS reason FROM ({_turns}) WHERE coalesce(s, '') = '' OR coalesce(u, '') = '' OR coalesce(a, '') = ''")
def shape_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shaping.shape(turns(spark, sf_dir), "dpo", SHAPES["dpo"][0])
    return out.quarantine.where("reason <> 'chosen == rejected'").select(F.col(RID).alias("conv_id"), "reason")


# -- reports -------------------------------------------------------------------------------------------------------------------

PROFILE = "rows, non_null, null_fraction, type, distinct_values, numeric_min, numeric_max, token_min, token_max, token_total"


def _profile(name: str, source: str, key: str, column: str, kind: str) -> None:
    value = f"min({column})::DOUBLE AS numeric_min, max({column})::DOUBLE AS numeric_max" if kind != "string" else "NULL::DOUBLE AS numeric_min, NULL::DOUBLE AS numeric_max"
    t = sql_tokens(column)
    told = f"min({t}) AS token_min, max({t}) AS token_max, sum({t})::BIGINT AS token_total" if kind == "string" else "NULL::BIGINT AS token_min, NULL::BIGINT AS token_max, NULL::BIGINT AS token_total"
    sql = f"SELECT count(*) AS rows, count({column}) AS non_null, (count(*) - count({column})) / count(*)::DOUBLE AS null_fraction, '{kind}' AS type, count(DISTINCT {column}) AS distinct_values, {value}, {told} FROM {source}"

    @query(name, sql)
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.profile(table(spark, sf_dir, source, key), column).select(*PROFILE.split(", "))


_profile("profile_text", "documents", "doc_id", "text", "string")
_profile("profile_int", "lineitem", "l_orderkey", "l_partkey", "int")
_profile("profile_double", "orders", "o_orderkey", "o_totalprice", "double")


@query("top_values", "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_values(table(spark, sf_dir, "part", "p_partkey"), "p_type")


@query("token_stats", f"SELECT l[1] AS min, l[-1] AS max, list_sum(l) / len(l)::DOUBLE AS mean, l[len(l) // 2 + 1] AS p50, l[least(len(l) - 1, floor(len(l) * 0.95::DOUBLE)::BIGINT) + 1] AS p95, list_sum(l)::BIGINT AS total FROM (SELECT list_sort(list({sql_tokens('text')})) AS l FROM documents)")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.token_stats(documents(spark, sf_dir), "text")


_edges = " ".join(f"WHEN t < {edge} THEN '{name}'" for edge, name in reports.BUCKETS[:-1])


@query("token_histogram", f"SELECT CASE {_edges} ELSE '8k+' END AS bucket, count(*) AS rows FROM (SELECT {sql_tokens('text')} AS t FROM documents) GROUP BY 1")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.token_histogram(documents(spark, sf_dir), "text").drop("place")


@query("language_mix", f"SELECT code, count(*) / sum(count(*)) OVER ()::DOUBLE AS fraction FROM ({sql_language('text', 'documents')}) GROUP BY code ORDER BY count(*) DESC, code LIMIT 8")
def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.language_mix(documents(spark, sf_dir), "text")


@query("difference", "SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'dropped' WHEN b.o_totalprice <> a.o_totalprice THEN 'modified' ELSE 'unchanged' END AS change, CASE WHEN b.o_totalprice <> a.o_totalprice THEN 'o_totalprice' ELSE '' END AS changed FROM (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) b FULL OUTER JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0) a USING (o_orderkey)")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey").select(RID, "o_orderkey", "o_totalprice", "o_orderstatus")
    after = orders.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END")).drop("o_orderstatus")
    found = reports.difference(orders.where("o_orderkey % 5 <> 0"), after)
    return found.select(F.col(RID).alias("o_orderkey"), "change", F.array_join("changed", ",").alias("changed"))


@query("sample_rows", "SELECT doc_id FROM documents WHERE doc_id < 100 OR ((doc_id - 100) % greatest(1, ((SELECT count(*) FROM documents) - 100) // 100) = 0 AND (doc_id - 100) / greatest(1, ((SELECT count(*) FROM documents) - 100) // 100) < 100) ")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(documents(spark, sf_dir), 100, 100).select("doc_id")


@query("search_rows", "SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(chr(31), c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)), 'build')")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search(table(spark, sf_dir, "customer", "c_custkey"), "Build").select("c_custkey")


@query("pipeline_slice", f"SELECT doc_id, lang, {sql_tokens('text')} AS token_count FROM (SELECT * FROM (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, text FROM (SELECT doc_id, lang, CASE WHEN lower({sql_trim('text')}) IN ({_nulls}) THEN NULL ELSE text END AS text FROM (SELECT doc_id, lang, {sql_normal('text')} AS text FROM documents)) GROUP BY coalesce(text, ''), text)) AS d WHERE doc_id IN (SELECT doc_id FROM ({sql_reasons('text', f'(SELECT doc_id, {sql_normal("text")} AS text FROM documents)')}) WHERE len(reasons) = 0)")
def pipeline_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, unify nulls, remove exact copies, filter by quality, count tokens: the flagship query."""
    steps = (ops.NormalizeText(("text",)), ops.UnifyNulls(("text",)), ops.DedupeExact(("text",)), ops.QualityFilter("text"), ops.AddTokenCount("text"), ops.SelectColumns(("doc_id", "lang", "token_count")))
    return plan(documents(spark, sf_dir), *steps)

