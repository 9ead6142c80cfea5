"""Free-text requirements to structured profiles (JD1-9), as a DataFrame operator over many texts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import strip

# Names looked for in requirement texts and how they are written in the profile.
SKILLS = {
    "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "go": "Go", "golang": "Go", "rust": "Rust", "c++": "C++",
    "java": "Java", "scala": "Scala", "kotlin": "Kotlin", "ruby": "Ruby", "php": "PHP", "c#": "C#", "sql": "SQL", "nosql": "NoSQL",
    "pytorch": "PyTorch", "tensorflow": "TensorFlow", "scikit-learn": "scikit-learn", "machine learning": "Machine Learning",
    "deep learning": "Deep Learning", "nlp": "NLP", "natural language processing": "NLP", "llm": "LLMs", "llms": "LLMs", "rag": "RAG",
    "prompt engineering": "Prompt Engineering", "hugging face": "Hugging Face", "huggingface": "Hugging Face", "computer vision": "Computer Vision",
    "opencv": "OpenCV", "peft": "PEFT", "lora": "LoRA", "qlora": "QLoRA", "milvus": "Milvus", "faiss": "FAISS", "qdrant": "Qdrant",
    "pinecone": "Pinecone", "weaviate": "Weaviate", "vector search": "Vector Search", "opensearch": "OpenSearch", "elasticsearch": "Elasticsearch",
    "langchain": "LangChain", "llamaindex": "LlamaIndex", "gans": "GANs", "reinforcement learning": "Reinforcement Learning",
    "statistical modeling": "Statistical Modeling", "embeddings": "Embeddings", "semantic search": "Semantic Search", "yolo": "YOLO", "cnn": "CNN",
    "aws": "AWS", "gcp": "GCP", "azure": "Azure", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "terraform": "Terraform",
    "git": "Git", "mlflow": "MLflow", "kubeflow": "Kubeflow", "bentoml": "BentoML",
}
# Soft skills, industries and places looked for likewise.
SOFT_SKILLS = {
    "communication": "Communication", "collaboration": "Collaboration", "leadership": "Leadership", "problem-solving": "Problem-solving",
    "problem solving": "Problem-solving", "teamwork": "Teamwork", "adaptability": "Adaptability", "creativity": "Creativity",
    "critical thinking": "Critical thinking", "mentorship": "Mentorship", "initiative": "Initiative", "presentation": "Presentation",
    "organizational": "Organizational", "time management": "Time management",
}
INDUSTRIES = {
    "fintech": "FinTech", "e-commerce": "E-commerce", "ecommerce": "E-commerce", "saas": "SaaS", "healthcare": "Healthcare", "finance": "Finance",
    "banking": "Banking", "automotive": "Automotive", "blockchain": "Blockchain", "crypto": "Crypto", "web3": "Web3", "cybersecurity": "Cybersecurity",
    "gaming": "Gaming", "education": "Education", "edtech": "EdTech", "retail": "Retail", "insurance": "Insurance",
}
LOCATIONS = {
    "remote": "Remote", "hybrid": "Hybrid", "onsite": "Onsite", "on-site": "Onsite", "bengaluru": "Bengaluru", "bangalore": "Bengaluru",
    "san francisco": "San Francisco", "sf": "San Francisco", "london": "London", "new york": "New York", "india": "India", "us": "US", "usa": "US", "uk": "UK",
}
SECTION_LENGTH = 50
# What a short line must hold to open a section; preferred is tested first.
PREFERRED_MARKS = ["preferred", "nice to have", "plus", "desirable", "good to have", "bonus", "assets"]
REQUIRED_MARKS = ["required", "must have", "requirements", "qualifications", "essential", "about you", "what you need"]
# Patterns of years of experience, in order of priority.
YEARS = [
    r"(?i)(\d+)\s*(?:to|-)\s*(\d+)\s*years?", r"(?i)(\d+)\s*\+\s*years?", r"(?i)(\d+)\s*years?\s*\+",
    r"(?i)(?:at least|minimum of|min)\s*(\d+)\s*years?", r"(?i)(\d+)\s*years?\s*(?:of\s*)?experience",
]


@dataclass(frozen=True)
class Requirement:
    """A parsed requirement as the ranking stages take it."""

    required_skills: list[str] = field(default_factory=list)
    preferred_skills: list[str] = field(default_factory=list)
    min_years: float | None = None
    max_years: float | None = None
    locations: list[str] = field(default_factory=list)
    industries: list[str] = field(default_factory=list)
    soft_skills: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"required_skills": self.required_skills, "preferred_skills": self.preferred_skills, "experience_range": {"min_years": self.min_years, "max_years": self.max_years}, "location_requirements": self.locations, "industry_requirements": self.industries, "soft_skills": self.soft_skills}, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Requirement:
        """ValueError or TypeError if the text is no profile."""
        d = json.loads(text)
        if not isinstance(d, dict):
            raise ValueError("no profile")
        years = d.get("experience_range") or {}
        lists = [d.get(k) or [] for k in ("required_skills", "preferred_skills", "location_requirements", "industry_requirements", "soft_skills")]
        if any(not isinstance(x, list) or any(not isinstance(s, str) for s in x) for x in lists):
            raise ValueError("lists of strings are expected")
        number = lambda v: None if v is None else float(v)
        return Requirement(lists[0], lists[1], number(years.get("min_years")), number(years.get("max_years")), lists[2], lists[3], lists[4])


def _pattern(keyword: str) -> str:
    """JD3/JD4: whole words; names that end in a sign stand between white space, commas or semicolons."""
    q = "\\Q" + keyword + "\\E"
    return rf"(?:^|[\s,;]){q}(?:$|[\s,;])" if keyword in ("c++", "c#") else rf"(?U)\b{q}\b"


def tags(c: Column, names: dict[str, str]) -> Column:
    """JD6, JD9: sorted distinct names whose keyword stands in the lower-cased text."""
    found = F.array(*[F.when(F.contains(c, F.lit(k)) & c.rlike(_pattern(k)), F.lit(v)) for k, v in names.items()])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def years_range(c: Column) -> Column:
    """JD7: (lo, hi) of the first match of the first pattern that matches; hi is null for one-number patterns."""
    group = lambda p, g: F.nullif(F.regexp_extract(c, p, g), F.lit("")).cast("double")
    options = [F.when(group(p, 1).isNotNull(), F.struct(group(p, 1).alias("lo"), (group(p, 2) if i == 0 else F.lit(None).cast("double")).alias("hi"))) for i, p in enumerate(YEARS)]
    return F.coalesce(*options)


def section_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """JD1, JD2: lines that aren't blank with the section in force: 2 preferred, 1 required, 0 before any heading."""
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), r"\R")).alias("line_no", "raw")).select(key, "line_no", strip(F.col("raw")).alias("line")).where("line <> ''")
    low = F.lower("line")
    has = lambda marks: F.greatest(*[F.contains(low, F.lit(m)) for m in marks])
    mark = F.when(F.length("line") < SECTION_LENGTH, F.when(has(PREFERRED_MARKS), 2).when(has(REQUIRED_MARKS), 1))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("mark", mark).withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(0)))


def parse_requirements(df: DataFrame, key: str, text: str) -> DataFrame:
    """One profile per text; null and blank texts give empty lists and no range. Lines before any heading count as required.

    A text is one group: its lines are tagged one by one and united, so that nothing but tags is shuffled.
    """
    lines = section_lines(df, key, text).withColumn("low", F.lower("line"))
    tech = tags(F.col("low"), SKILLS)
    none = F.array().cast("array<string>")
    per = lines.select(
        key, F.when(F.col("section") == 2, none).otherwise(tech).alias("req"), F.when(F.col("section") == 2, tech).otherwise(none).alias("pref"),
        tags(F.col("low"), SOFT_SKILLS).alias("soft"), tags(F.col("low"), INDUSTRIES).alias("ind"), tags(F.col("low"), LOCATIONS).alias("loc"),
        F.struct("line_no", "line").alias("l"),
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), " ").alias("all")
    g = per.groupBy(key).agg(*(union(c) for c in ("req", "pref", "soft", "ind", "loc")), joined).withColumn("y", years_range(F.col("all")))
    out = g.select(key, F.col("req").alias("required_skills"), F.array_except("pref", "req").alias("preferred_skills"), F.col("y.lo").alias("min_years"), F.col("y.hi").alias("max_years"), F.col("loc").alias("locations"), F.col("ind").alias("industries"), F.col("soft").alias("soft_skills"))
    empty = df.select(key).distinct().join(out, key, "left")
    lists = ("required_skills", "preferred_skills", "locations", "industries", "soft_skills")
    return empty.select(key, *(F.coalesce(c, none).alias(c) if c in lists else F.col(c) for c in out.columns if c != key))


def parse(spark: SparkSession, text: str) -> Requirement:
    """The profile of one text."""
    df = spark.createDataFrame([(1, text)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType())]))
    r = parse_requirements(df, "k", "t").first()
    return Requirement(list(r["required_skills"]), list(r["preferred_skills"]), r["min_years"], r["max_years"], list(r["locations"]), list(r["industries"]), list(r["soft_skills"]))
