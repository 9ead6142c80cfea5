"""The stages as functions and as a command (ORC1-3): ``spark-submit -m loomspark.plans.pipeline --stage all ...``.

Raw lines are parsed once and written; flat records, anomalies and features are three projections of that table. Later
stages read what earlier ones wrote, so that each can be run alone.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import checks, copies, features, match, normalise, ranker, requirement, retrieval, scoring, traps, validate
from loomspark.sources import artifacts, records

STAGES = ("ingest", "anomalies", "features", "requirement", "retrieve", "match", "traps", "copies", "learn", "rerank", "result")
MODEL = "hashed-64"


class Pipeline:
    """Stages over a working folder; ``as_of`` pins all dates."""

    def __init__(self, spark: SparkSession, work: str, lines: str | None = None, need: str | None = None, top_retrieved: int = 5000, top_ranked: int = 500, top_result: int = 100, rounds: int = 100, filter_flagged: bool = True, as_of=checks.AS_OF, paths: dict[str, str] | None = None, vectors: str | None = None, scores: str | None = None):
        self.paths = paths or {}
        self.spark, self.work, self.lines, self.need = spark, work.rstrip("/"), lines, need
        self.top_retrieved, self.top_ranked, self.top_result, self.rounds, self.filter_flagged, self.as_of = top_retrieved, top_ranked, top_result, rounds, filter_flagged, as_of

        self.vectors, self.scores = vectors or self.path("vectors.parquet"), scores or self.path("scores.parquet")

    def path(self, name: str) -> str:
        """Where an artefact lies: ``paths`` may name another place for it."""
        return self.paths.get(name, f"{self.work}/{name}")

    def read(self, name: str) -> DataFrame:
        artifacts.require(self.spark, self.path(name))
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> int:
        return artifacts.write_parquet(df, self.path(name))

    def ingest(self) -> records.LoadReport:
        lines = records.parse_lines(records.read_lines(self.spark, self.lines))
        self.write(lines, "lines.parquet")
        report = records.report(self.read("lines.parquet"))
        if not report.parsed:
            raise ValueError(f"no valid line in {self.lines}: {report.summary()}")
        # of several records of one id all stages see the same one: that of the largest line
        ok = self.read("lines.parquet").where("status = 'ok'")
        kept = ok.groupBy("candidate_id").agg(F.max("value").alias("value"))
        self.write(ok.join(kept, ["candidate_id", "value"], "left_semi").drop("value", "status", "errors").dropDuplicates(["candidate_id"]), "records.parquet")
        self.write(normalise.flatten(self._nested()), "candidates.parquet")
        return report

    def _nested(self) -> DataFrame:
        return self.read("records.parquet")

    def anomalies(self) -> int:
        return self.write(checks.detect(self._nested(), as_of=self.as_of), "anomalies.parquet")

    def features(self) -> int:
        return self.write(features.extract(self._nested()), "features.parquet")

    def requirement(self) -> None:
        artifacts.write_requirement(self.spark, requirement.parse(self.spark, artifacts.read_text(self.spark, self.need)), self.path("requirement.json"))

    def _need(self) -> requirement.Requirement:
        artifacts.require(self.spark, self.path("requirement.json"))
        return artifacts.read_requirement(self.spark, self.path("requirement.json"))

    def retrieve(self) -> int:
        query = retrieval.query_text(self._need())
        cache = artifacts.read_cache(self.spark, self.vectors, artifacts.VECTOR_CACHE)
        docs, fresh = retrieval.encode_missing(self.read("candidates.parquet").select("candidate_id", "normalized_text"), "normalized_text", cache, MODEL)
        self.write(docs.select("candidate_id", "normalized_text", "vector"), "encoded.parquet")
        if not fresh.isEmpty():
            new = self.read("encoded.parquet").select(F.lit(MODEL).alias("model"), F.sha2("normalized_text", 256).alias("digest"), "vector").dropDuplicates(["digest"])
            artifacts.append_cache(new.join(cache.select("digest"), "digest", "left_anti").select("model", "digest", "vector"), self.vectors)
        vector = list(self.spark.range(1).select(retrieval.hashed_vector(F.lit(query)).alias("v")).first()["v"])
        return self.write(retrieval.hybrid(self.read("encoded.parquet"), "candidate_id", "normalized_text", "vector", query, vector, self.top_retrieved), "retrieved.parquet")

    def match(self) -> int:
        return self.write(match.match_features(self.read("candidates.parquet"), self.read("features.parquet"), self.read("anomalies.parquet"), self.read("retrieved.parquet"), self._need(), self.filter_flagged), "match.parquet")

    def traps(self) -> int:
        return self.write(traps.detect_traps(self.read("candidates.parquet"), self.read("features.parquet"), self.as_of), "traps.parquet")

    def copies(self) -> int:
        return self.write(copies.resolve(self.read("candidates.parquet"), self.read("features.parquet"), self.as_of), "copies.parquet")

    def compiled(self) -> DataFrame:
        return ranker.compile_table(*(self.read(f"{n}.parquet") for n in ("retrieved", "match", "features", "traps", "copies", "anomalies", "candidates")))

    def learn(self, train_only: bool = False, rank_only: bool = False) -> int:
        df = self.compiled()
        if not rank_only:
            artifacts.write_model(self.spark, ranker.train(df, self.rounds), self.path("model.json"))
        if train_only:
            return 0
        return self.write(ranker.rank(df, artifacts.read_model(self.spark, self.path("model.json")), self.top_ranked), "ranked.parquet")

    def rerank(self) -> int:
        cache = artifacts.read_cache(self.spark, self.scores, artifacts.SCORE_CACHE)
        best, fresh = ranker.rerank(self.read("ranked.parquet"), self.read("candidates.parquet"), artifacts.read_text(self.spark, self.need), cache, top_k=self.top_ranked)
        n = self.write(best, "reranked.parquet")
        artifacts.append_cache(fresh, self.scores)
        return n

    def result(self) -> DataFrame:
        """Writes the result, validates it, and raises ValueError with the report if a check failed."""
        out = scoring.final_table(self.compiled(), self.read("reranked.parquet"), self.top_result)
        artifacts.write_result_csv(out, self.path("result.csv"))
        report = validate.table_report(artifacts.read_csv(self.spark, self.path("result.csv"), "candidate_id string, rank string, score string, reasoning string"), self.read("candidates.parquet"), self.top_result)
        if not validate.passed(report):
            raise ValueError(artifacts.print_report(report))
        return report

    def run(self, stage: str = "all", train_only: bool = False, rank_only: bool = False) -> None:
        for s in STAGES if stage == "all" else (stage,):
            if s == "learn":
                self.learn(train_only, rank_only)
                if train_only:
                    return
            else:
                getattr(self, s)()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Candidate discovery and ranking on Spark.")
    p.add_argument("--stage", choices=[*STAGES, "all"], default="all")
    p.add_argument("--lines")
    p.add_argument("--need")
    p.add_argument("--work", required=True)
    for name, default in (("--top-retrieved", 5000), ("--top-ranked", 500), ("--top-result", 100), ("--rounds", 100)):
        p.add_argument(name, type=int, default=default)
    p.add_argument("--vector-cache")
    p.add_argument("--score-cache")
    p.add_argument("--output", action="append", default=[], metavar="NAME=PATH", help="another place for an artefact, such as retrieved.parquet=PATH; may be repeated")
    p.add_argument("--keep-flagged", action="store_true")
    p.add_argument("--train-only", action="store_true")
    p.add_argument("--rank-only", action="store_true")
    a = p.parse_args(argv)
    from loomspark.session import get_session

    Pipeline(get_session(), a.work, a.lines, a.need, a.top_retrieved, a.top_ranked, a.top_result, a.rounds, not a.keep_flagged, paths=dict(x.split("=", 1) for x in a.output), vectors=a.vector_cache, scores=a.score_cache).run(a.stage, a.train_only, a.rank_only)


if __name__ == "__main__":
    main()
