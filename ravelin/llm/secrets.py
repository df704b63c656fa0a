"""Secret scan with DataFrame operations only: fixed patterns, and runs that look random to character Markov models.

Two first-order models of characters, one of random strings and one of ordinary identifiers and words, are trained from labelled samples;
their log-likelihood ratio is a table of 128 x 128 whole numbers. A run of token characters whose transitions sum to enough is a
secret. Places come from the lengths of what stands between matches: they are summed over a compact table of lengths, never over
texts, and no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.store import written

#: The patterns that always count, in the order of their kinds. Letters of ``assign`` match in either case, whatever the
#: engine folds; its second group needs LEAST_VALUE characters.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Characters of the runs that the models judge, their number, and the fewest of a run.
RUN_CHARS, N_CHARS, LEAST_RUN = "A-Za-z0-9+/_=-", 67, 20
#: Log-likelihood ratio (in millionths of a nat) from which a run is random: odds of e^12 for it, against rare secrets.
LEAST_RATIO = 12_000_000
#: Longer runs are summed in pieces of so many characters; transitions between pieces don't count.
PIECE = 1024
#: What is added to the count of every transition, and how often a listed identifier counts.
PRIOR, IDENTIFIER_WEIGHT = 0.5, 200
#: Documents whose words are samples of the ordinary, at most, and generated samples of each kind of random string.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 4000
#: Ordinary identifiers, paths, rulers and numbers.
ORDINARY = """
max_connections min_pool_size user_name first_name last_name created_at updated_at deleted_at is_active has_children parent_id order_id
customer_address shipping_method payment_status total_amount unit_price line_number page_count file_path base_url api_version
request_timeout response_code error_message log_level cache_size buffer_length default_encoding content_type last_modified
getElementById addEventListener querySelectorAll setTimeout requestAnimationFrame toString hashCode equalsIgnoreCase
StringBuilder ArrayList HashMap IllegalArgumentException NullPointerException InputStreamReader BufferedWriter ThreadPoolExecutor
HttpServletRequest XMLHttpRequest JSONObject parseInt readFileSync writeFileSync createElement appendChild innerHTML
MAX_VALUE MIN_VALUE DEFAULT_TIMEOUT BUFFER_SIZE CONTENT_LENGTH HTTP_NOT_FOUND INTERNAL_SERVER_ERROR PATH_SEPARATOR JAVA_HOME
LD_LIBRARY_PATH PYTHONPATH NODE_ENV DATABASE_URL LOG_LEVEL README LICENSE CONTRIBUTING CHANGELOG
background-color font-family text-align margin-left border-radius align-items justify-content grid-template-columns
data-toggle aria-labelledby navbar-collapse btn-primary col-md-offset main-content-wrapper site-footer-links
/usr/local/bin/python /etc/nginx/conf.d/default /var/log/system /home/user/documents/report index/articles/archive/latest
src/main/java/org/example/service/impl docs/getting-started/installation wp-content/uploads/images/header
application/x-www-form-urlencoded text/html+plain internationalization misunderstandings counterrevolutionary
------------------------ ======================== ________________________ ++++++++++++++++ //////////////// 0000000000000000
xxxxxxxxxxxxxxxxxxxx aaaaaaaaaaaaaaaaaaaa XXXXXXXXXXXXXXXX 1234567890123456 2024-01-15T09-30-00 2023-12-31 1999-07-04 978-3-16-148410-0
555-0100-4477 version-2-1-0 release-1-18-3 utf-8 iso-8859-1 sha-256 x86_64 i18n l10n mp3 h264 windows-1252 area51 route66
"""
KINDS = ["assign", "access", "hex", "random"]


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, random, weight) of labelled strings.

    Random ones are generated: digests in hexadecimal of either case, in base 64 and in its form for addresses. Ordinary ones are listed
    identifiers, decimal numbers, and the distinct short runs outside ``assign`` matches of ``sample_docs`` documents at most, which a
    hash of the id picks, as they stand and in capitals.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    code = F.substring(F.base64(F.unhex(digest)), 1, 40)
    generated = spark.range(SAMPLE_STRINGS)
    strings = generated.select(F.explode(F.array(F.substring(digest, 1, 40), F.upper(F.substring(digest, 9, 40)), code, F.translate(code, "+/", "-_"), F.translate(code, "+/", "xQ"))).alias("text"))
    random = strings.select("text", F.lit(True).alias("random"), F.lit(1).alias("weight"))
    numbers = generated.select(F.translate(F.substring(digest, 1, 16), "abcdef", "012345").alias("text"), F.lit(False), F.lit(1))
    listed = spark.range(1).select(F.explode(F.split(F.lit(" ".join(ORDINARY.split())), " ")).alias("text"), F.lit(False), F.lit(IDENTIFIER_WEIGHT))
    ids = [r.id for r in docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs).collect()]
    text = F.regexp_replace(F.col(text_col).cast("string"), ASSIGN, " ")
    run = F.explode(F.regexp_extract_all(text, F.lit(f"(?<![{RUN_CHARS}])[{RUN_CHARS}]{{2,{LEAST_RUN - 1}}}(?![{RUN_CHARS}])"), F.lit(0)))
    words = docs.where(F.col(id_col).isin(ids)).select(run.alias("text")).select(F.explode(F.array("text", F.upper("text"))).alias("text")).distinct().select("text", F.lit(False), F.lit(1))
    return random.union(numbers).union(listed).union(words)


def fit(labelled: DataFrame) -> list[int]:
    """The log-likelihood ratio, in millionths of a nat, of every transition between ASCII characters (128 x 128): how much likelier
    random strings have it. ``labelled`` has (text, random, weight). At most 2 x 128 x 128 counts reach the driver."""
    chars = F.split("text", "")
    pairs = labelled.select("random", "weight", F.explode(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.length("text") - 1, F.lit(0))), lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))).alias("z"))
    rows = pairs.where("z.b is not null and z.a < 128 and z.b < 128 and z.a > 0 and z.b > 0").groupBy("random", "z.a", "z.b").agg(F.sum("weight").alias("n")).collect()
    n, of = {}, {}
    for r in rows:
        n[r.random, r.a, r.b] = r.n
        of[r.random, r.a] = of.get((r.random, r.a), 0) + r.n

    def log(random: bool, a: int, b: int) -> float:
        return math.log((n.get((random, a, b), 0) + PRIOR) / (of.get((random, a), 0) + PRIOR * N_CHARS))

    return [round(1e6 * (log(True, a, b) - log(False, a, b))) for a in range(128) for b in range(128)]


def ratio(run: Column, table: list[int]) -> Column:
    """Column: the sum of a run's transitions in ``table``."""
    steps = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # one constant; a look-up is one step

    def step(state: Column, char: Column) -> Column:
        code = F.ascii(char)
        move = F.when(state["last"] >= 0, F.get(steps, state["last"] * 128 + code)).otherwise(F.lit(0).cast("long"))
        return F.struct(code.alias("last"), (state["sum"] + move).alias("sum"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))
    pieces = F.regexp_extract_all(run, F.lit(".{1,%d}" % PIECE), F.lit(0))
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda all_, piece: all_ + F.aggregate(F.split(piece, ""), start, step, lambda s: s["sum"]))


def _lengths(text: Column, pattern: str, kind: int, counts) -> Column:
    """Column: array of (kind, gap before the match, length, whether it counts) of all matches from left to right, none overlapping.

    Both arrays are arguments of one function, so each is made once a text.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    all_ = F.zip_with(between, found, lambda b, m: F.struct(F.lit(kind).alias("kind"), F.length(b).alias("gap"), F.length(m).alias("size"), counts(m).alias("counts")))
    return F.filter(all_, lambda s: s["size"].isNotNull())


def spans(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((row, doc_id) of all rows, (row, kind, start, end) of all spans): places in code points, the end exclusive.

    A random run that overlaps a span of another kind is no span of its own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    yes = lambda m: F.lit(True)
    patterns = [
        (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE),
        (ACCESS, yes),
        (HEX, yes),
        (f"[{RUN_CHARS}]{{{LEAST_RUN},}}", lambda m: ratio(m, table) >= LEAST_RATIO),
    ]
    arrays = [_lengths(text, p, k, counts).alias(KINDS[k]) for k, (p, counts) in enumerate(patterns)]
    # row numbers hold once they are written; only lengths are
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), *arrays), "lengths")
    met = rows.select("row", F.posexplode(F.concat(*KINDS)).alias("place", "s")).select("row", "place", "s.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).where("counts")
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < len(KINDS) - 1
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    over = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    return rows.select("row", "doc_id"), placed.withColumn("over", over).where(base | ~F.col("over")).select("row", "kind", "start", "end")


def scan(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Null, empty and clean texts have no spans ("" and the digest of ""). Repeated rows and rows without an id are each reported, spans that
    start together are in the order of KINDS, texts and runs of any length are scanned whole, an empty table gives no rows, and other
    columns are never read.
    """
    rows, found = spans(docs, table, id_col, text_col)

    def joined(which: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(which, F.struct("start", "kind", "end"))))
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    counts = [F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])]
    report = found.groupBy("row").agg(*counts, joined(F.col("kind") < len(KINDS) - 1).alias("base"), joined(F.lit(True)).alias("spans"))
    none = [F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS[:-1]]
    return rows.join(report, "row", "left").select("doc_id", *none, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` of ``docs`` with models trained on their samples."""
    return scan(docs, fit(samples(docs, id_col, text_col)), id_col, text_col)
