"""Trusted sources by topic, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

# fixed values: topics with keywords and sources (url, language, crawl depth, crawl pages); the descriptions are ours
CATEGORIES: dict[str, tuple[str, list[str], list[tuple[str, str, int, int]]]] = {
    "thai_news": (
        "What goes on in Thailand",
        ["ข่าว", "การเมือง", "เศรษฐกิจ", "ไทย", "news", "thailand", "thai"],
        [("https://www.matichon.co.th", "th", 2, 200), ("https://thestandard.co", "th", 2, 200), ("https://www.thairath.co.th", "th", 2, 200), ("https://www.bangkokbiznews.com", "th", 2, 200), ("https://www.thaipbs.or.th", "th", 2, 200)],
    ),
    "thai_finance": (
        "Money and markets in Thailand",
        ["หุ้น", "ตลาดหลักทรัพย์", "การลงทุน", "ดอกเบี้ย", "ธนาคาร", "stock", "finance", "investment"],
        [("https://www.bot.or.th", "th", 2, 200), ("https://www.sec.or.th", "th", 2, 200), ("https://www.set.or.th", "th", 2, 200), ("https://www.thansettakij.com", "th", 2, 200)],
    ),
    "thai_law": (
        "Statutes and courts of Thailand",
        ["กฎหมาย", "พระราชบัญญัติ", "ศาล", "นิติกรรม", "law", "legal", "regulation", "pdpa"],
        [("https://www.ratchakitcha.soc.go.th", "th", 1, 200), ("https://ilaw.or.th", "th", 2, 200), ("https://www.oja.go.th", "th", 2, 200)],
    ),
    "academic_ai": (
        "Papers on learning machines",
        ["ai", "machine learning", "deep learning", "nlp", "llm", "neural network", "transformer", "rag", "fine-tuning", "research", "paper", "arxiv"],
        [("https://arxiv.org/list/cs.AI/recent", "en", 1, 100), ("https://arxiv.org/list/cs.LG/recent", "en", 1, 100), ("https://arxiv.org/list/cs.CL/recent", "en", 1, 100), ("https://huggingface.co/blog", "en", 2, 200)],
    ),
    "tech_docs": (
        "Manuals for people who write programs",
        ["python", "javascript", "api", "framework", "library", "docker", "kubernetes", "database", "code", "programming", "software", "developer"],
        [("https://docs.python.org/3", "en", 2, 200), ("https://fastapi.tiangolo.com", "en", 2, 200), ("https://docs.docker.com", "en", 2, 200)],
    ),
    "thai_government": (
        "What Thai authorities publish",
        ["รัฐบาล", "นโยบาย", "ราชการ", "government", "policy", "official"],
        [("https://data.go.th", "th", 1, 200), ("https://www.thaigov.go.th", "th", 2, 200)],
    ),
    "general": (
        "Whatever an encyclopedia holds",
        ["what", "how", "why", "คืออะไร", "ทำไม", "อย่างไร"],
        [("https://en.wikipedia.org/wiki/Main_Page", "en", 1, 200), ("https://th.wikipedia.org/wiki/หน้าหลัก", "th", 1, 200)],
    ),
}
# fixed values: languages that go with a topic
LANGUAGES = {"thai_news": "th", "thai_finance": "th", "thai_law": "th", "thai_government": "th", "tech_docs": "en"}


def categories(spark: SparkSession) -> DataFrame:
    """(ord, category, description, keywords, language)."""
    rows = [(k, name, d, words, LANGUAGES.get(name)) for k, (name, (d, words, _)) in enumerate(CATEGORIES.items())]
    return spark.createDataFrame(rows, "ord int, category string, description string, keywords array<string>, language string")


def sources(spark: SparkSession) -> DataFrame:
    """(ord, category, url, domain without www., language, crawl_depth, crawl_pages)."""
    rows = [(k, name, *s) for k, (name, (_, _, own)) in enumerate(CATEGORIES.items()) for s in own]
    out = spark.createDataFrame(rows, "ord int, category string, url string, language string, crawl_depth int, crawl_pages int")
    return out.withColumn("domain", U.domain(F.col("url")))


def domains(spark: SparkSession) -> DataFrame:
    return sources(spark).select("domain").distinct()


def crawl_limits(spark: SparkSession) -> DataFrame:
    """Largest depth and page count of every topic's sources."""
    return sources(spark).groupBy("category").agg(F.max("crawl_depth").alias("crawl_depth"), F.max("crawl_pages").alias("crawl_pages"))


def should_auto_crawl(spark: SparkSession, indexed: DataFrame) -> DataFrame:
    """Topics none of whose domains is indexed (domain)."""
    covered = sources(spark).join(indexed.select("domain"), "domain", "left_semi").select("category").distinct()
    return categories(spark).join(covered, "category", "left_anti").select("category")


def resolve_category(df: DataFrame, dimension: DataFrame, url: str = "url", given: str | None = None) -> DataFrame:
    """Adds source_domain and category: given metadata first, then the first topic that lists the domain, then 'general'."""
    first = dimension.groupBy("domain").agg(F.min_by("category", "ord").alias("_category"))
    out = df.withColumn("source_domain", U.domain(F.col(url))).join(F.broadcast(first), F.col("source_domain") == F.col("domain"), "left").drop("domain")  # the registry is a fixed list
    own = [F.nullif(F.col(given), F.lit(""))] if given else []
    return out.withColumn("category", F.coalesce(*own, "_category", F.lit("general"))).drop("_category")
