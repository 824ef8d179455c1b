"""Batch text matcher X1-X8, A11: word-vector mean, cosine and keyword score.

The vector work is a distributed aggregation, not a per-row Python loop:
tokens are counted per (message, word) first (repeats count), joined to the
vector table (J11, out-of-vocabulary words drop out), and the mean vector is
an ``avg`` per (message, dimension) - no group ever holds a whole message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_RE = r"([\p{L}\p{N}_]+)"
HEAD_WORDS = 1024  # most frequent words, whose vectors are broadcast


def tokens(c) -> Column:
    """Lower-case Unicode word tokens (Cyrillic included)."""
    return F.regexp_extract_all(F.lower(c if isinstance(c, Column) else F.col(c)), F.lit(TOKEN_RE), 1)


def mean_vectors(docs: DataFrame, id_col: str, text_col: str, vectors: DataFrame, dim: int,
                 head_words: int = HEAD_WORDS) -> DataFrame:
    """(id, vec) - mean of the known word vectors, zero vector if none.

    Frequent words would be hot keys of the join by word (J11).  The most
    frequent ones, ``head_words`` whatever the corpus (0: none, for a few texts), are
    broadcast with their vectors; only the others, each in less than one in
    ``head_words`` of the rows, are shuffled by word."""
    vectors = vectors.select("word", "vec")
    counted = (docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("word"))
               .groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("_n")))
    if head_words:
        # one row a (message, word) meets the join, so rows are what makes a word hot
        top = counted.groupBy("word").agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("_rows"), "word").limit(head_words)
        head = F.broadcast(F.broadcast(top.select("word")).join(vectors, "word", "left").withColumn("_head", F.lit(True)))
        split = counted.join(head, "word", "left")
        rest = split.where(F.col("_head").isNull()).select(id_col, "word", "_n").join(vectors, "word")
        known = split.where(F.col("_head") & F.col("vec").isNotNull()).select(id_col, "vec", "_n").unionByName(rest.select(id_col, "vec", "_n"))
    else:
        known = counted.join(vectors, "word").select(id_col, "vec", "_n")
    # one row per (task, message): all dimensions are sums of one aggregation
    means = F.expr(f"array({', '.join(f'sum(cast(vec[{d}] as double) * _n) / sum(_n)' for d in range(dim))})")
    vec = known.groupBy(id_col).agg(means.alias("vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return (docs.select(id_col).join(vec, id_col, "left")
            .select(id_col, F.coalesce(F.col("vec"), zero).alias("vec")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either norm is 0."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def any_substring(text: Column, stems) -> Column:
    """Any stem occurs as a substring of the lower-cased text."""
    low = F.lower(text)
    cond = F.lit(False)
    for s in stems:
        cond = cond | F.contains(low, F.lit(s.lower()))
    return cond


# fixed values: keyword sentences and stems of the matcher
JOB_KEYWORDS = "ищу вакансия работа требуется нужен найму удаленка сотрудник специалист"
MARKET_KEYWORDS = "вайлдберриз wildberries озон ozon маркетплейс товар продажа магазин"
MANAGER_KEYWORDS = "менеджер управляющий координатор помощник ассистент администратор"
MARKET_STEMS = ("вб", "wb", "wildberries", "вайлдберриз", "озон", "ozon", "маркетплейс")
INTENT_STEMS = ("ищу", "нужен", "требуется", "вакансия", "найму", "работа", "сотрудник", "специалист", "помощник")
MANAGER_STEMS = ("менеджер", "управляющ", "координатор", "помощник", "ассистент")

# fixed values: score weights, bonuses and thresholds
W_JOB, W_MARKET, W_MANAGER = 0.3, 0.4, 0.3
BONUS_MARKET, BONUS_INTENT, BONUS_MANAGER = 0.3, 0.2, 0.2
MATCH_THRESHOLD = 0.35
PREVIEW_COUNT, PREVIEW_CHARS = 5, 60


def analyse(messages: DataFrame, vectors: DataFrame, dim: int, job_text: str = JOB_KEYWORDS, market_text: str = MARKET_KEYWORDS,
            manager_text: str = MANAGER_KEYWORDS, market_stems=MARKET_STEMS, intent_stems=INTENT_STEMS, manager_stems=MANAGER_STEMS,
            id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """Per message scores, keyword flags, confidence and decision;
    input columns pass through."""
    mv = mean_vectors(messages, id_col, text_col, vectors, dim)
    kw = vectors.sparkSession.createDataFrame(
        [("job_vec", job_text), ("market_vec", market_text), ("manager_vec", manager_text)], "rid string, text string")
    ref_rows = mean_vectors(kw, "rid", "text", vectors, dim, head_words=0)
    # three keyword vectors in one pass, folded into one struct: a scalar subquery, not a join
    names = ("job_vec", "market_vec", "manager_vec")
    refs = ref_rows.agg(F.struct(*[F.max(F.when(F.col("rid") == n, F.col("vec"))).alias(n) for n in names]).alias("refs"))
    scored = messages.join(mv, id_col).withColumn("_refs", refs.scalar())
    job, market, manager = (cosine(F.col("vec"), F.col(f"_refs.{n}")) for n in names)
    t = F.col(text_col)
    out = scored.select(
        *messages.columns,
        job.alias("job_intent_score"), market.alias("marketplace_score"), manager.alias("manager_role_score"),
        any_substring(t, market_stems).alias("has_marketplace"), any_substring(t, intent_stems).alias("has_job_intent"),
        any_substring(t, manager_stems).alias("has_manager_role"))
    semantic = (F.col("job_intent_score") * W_JOB + F.col("marketplace_score") * W_MARKET
                + F.col("manager_role_score") * W_MANAGER)
    bonus = (F.when(F.col("has_marketplace"), BONUS_MARKET).otherwise(0.0)
             + F.when(F.col("has_job_intent"), BONUS_INTENT).otherwise(0.0)
             + F.when(F.col("has_manager_role"), BONUS_MANAGER).otherwise(0.0))
    conf = F.least(semantic + bonus, F.lit(1.0))
    return (out.withColumn("confidence", conf)
            .withColumn("is_job_search", (F.col("confidence") >= MATCH_THRESHOLD)
                        | (F.col("has_marketplace") & F.col("has_job_intent"))))


def nested(analysed: DataFrame) -> DataFrame:
    """The scores and flags as two structs beside the input columns."""
    scores = {"job_intent": "job_intent_score", "marketplace": "marketplace_score", "manager_role": "manager_role_score"}
    flags = {"marketplace": "has_marketplace", "job_intent": "has_job_intent", "manager_role": "has_manager_role"}
    flat = [*scores.values(), *flags.values()]
    return analysed.select(*[c for c in analysed.columns if c not in flat],
                           F.struct(*[F.col(c).alias(n) for n, c in scores.items()]).alias("scores"),
                           F.struct(*[F.col(c).alias(n) for n, c in flags.items()]).alias("flags"))


def preview(analysed: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """First five non-matching messages by id, text cut to 60 chars."""
    return (analysed.where(~F.col("is_job_search")).orderBy(id_col).limit(PREVIEW_COUNT)
            .select(id_col, F.substring(F.col(text_col), 1, PREVIEW_CHARS).alias("preview")))


def summary(analysed: DataFrame) -> DataFrame:
    """Total, matches, match share, mean confidence of matches (0 if none)."""
    return analysed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_job_search")).cast("bigint").alias("matches"),
        (F.count_if(F.col("is_job_search")) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("match_share"),
        F.coalesce(F.avg(F.when(F.col("is_job_search"), F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"))
