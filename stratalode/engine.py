"""One method for each operator over a source tree; results are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import code, connections, detectors, facts, filters, fixers, graph, matching, offsets, relational, rollups, sinks
from .operators.rules import RULES
from .sources import documents, tree
from .sources.documents import ScanConfig


class Engine:
    """Facts are made once and stored where spark.checkpoint.dir or `store` says; analyses are queries over them."""

    def __init__(self, spark: SparkSession, root: str | None = None, files: DataFrame | None = None, config: ScanConfig | None = None, store: str | None = None):
        self.spark, self.root, self.config = spark, root, config or ScanConfig()
        self._files = files if files is not None else tree.files(spark, root, largest=self.config.largest)
        self.store, self._facts = store, None

    def files(self) -> DataFrame:
        return filters.excluded(self._files, list(self.config.exclude))

    def lines(self) -> DataFrame:
        return offsets.lines(self.files(), "rel", "content")

    def rules(self) -> list[tuple]:
        own = documents.rule_files(self.config.rules_dir) if self.config.rules_dir else []
        most = filters.SEVERITIES.index(self.config.severity) + 1
        return [r for r in [*RULES, *own] if r[1] in filters.SEVERITIES[:most] and r[0] not in self.config.suppress]

    def scan(self, changed_since: DataFrame | None = None, snapshot: DataFrame | None = None) -> DataFrame:
        f = self.files()
        if changed_since is not None:
            f = filters.since(f, changed_since)
        if snapshot is not None and self.config.incremental:
            f = relational.changed(f, snapshot, "rel", "sha256")
        return matching.scan(f, self.rules(), self.config.policy, self.config.taint, self.config.include_tests)

    def fact(self, name: str) -> DataFrame:
        if self._facts is None:
            got = facts.extract(self.files())
            if self.store:
                got.write.mode("overwrite").parquet(self.store)
                got = self.spark.read.parquet(self.store)
            self._facts = got
        return facts.fact(self._facts, name)

    def smells(self) -> DataFrame:
        return code.smells(self.fact("functions"), self.fact("classes"), self.fact("tries"), self.fact("constants"))

    def dead_functions(self) -> DataFrame:
        return code.dead_functions(self.fact("functions"), self.fact("calls"))

    def unused_imports(self) -> DataFrame:
        return code.unused_imports(self.fact("imports"), self.fact("names"), self.fact("strings"))

    def call_graph(self) -> DataFrame:
        return code.call_nodes(self.fact("functions"), code.call_edges(self.fact("functions"), self.fact("calls")))

    def circular_calls(self, most: int | None = None) -> DataFrame:
        """Cycles of any length; see call_components() where there are very many."""
        return graph.circular(code.call_edges(self.fact("functions"), self.fact("calls")), most)

    def call_components(self) -> DataFrame:
        return graph.components(code.call_edges(self.fact("functions"), self.fact("calls")))

    def module_cycles(self, full: bool = False, most: int | None = None) -> DataFrame:
        return graph.circular(code.module_edges(self.fact("imports"), self.files(), full), most)

    def coupling(self, full: bool = False) -> DataFrame:
        e = code.module_edges(self.fact("imports"), self.files(), full)
        return relational.coupling(e, code.layers(self.files(), self.fact("imports")).where("layer != 'external'").select("module").distinct(), "module")

    def architecture(self) -> DataFrame:
        return code.layers(self.files(), self.fact("imports"))

    def duplicates(self) -> DataFrame:
        return relational.duplicate_blocks(offsets.lines(self.files().where("lang = 'python'"), "rel", "content"), "rel")

    def debt(self) -> DataFrame:
        return detectors.debt(self.lines(), "rel")

    def generated(self) -> DataFrame:
        return detectors.generated(self.lines(), "rel")

    def web_smells(self) -> DataFrame:
        return detectors.web(offsets.lines(self.files().where("lang in ('javascript', 'html') or ext = 'css'"), "rel", "content"), "rel")

    def secrets(self) -> DataFrame:
        return detectors.secrets(self.lines(), "rel")

    def connections(self) -> DataFrame:
        return relational.wiring(code.ui_calls(self.files()), code.server_routes(self.files()), "route")

    def connection_places(self) -> DataFrame:
        return connections.connected(code.ui_calls(self.files()), code.server_routes(self.files()))

    def orphan_map(self) -> DataFrame:
        return code.orphans(code.ui_calls(self.files()), code.server_routes(self.files()))

    def risk_heatmap(self, findings: DataFrame, commits: DataFrame) -> DataFrame:
        weigh = lambda df: rollups.by_severity(df["severity"], 3.0, 2.0, 1.0, 1.0)
        s = self.smells()
        signals = rollups.finding_signals(findings, "rel").unionByName(s.select("rel", F.lit("smells").alias("kind"), weigh(s).alias("weight")))
        signals = signals.unionByName(commits.select(F.col("path").alias("rel"), F.lit("churn").alias("kind"), F.lit(1.0).alias("weight")))
        return rollups.heatmap(signals, "rel")

    def project_review(self, findings: DataFrame) -> DataFrame:
        return rollups.review(findings)

    def fix(self, findings: DataFrame) -> DataFrame:
        return fixers.fix(self.files(), findings)

    def sarif(self, findings: DataFrame, tool: str = "source-scan") -> str:
        return sinks.sarif(findings, tool)

    def gate(self, findings: DataFrame) -> DataFrame:
        c = self.config
        counts = rollups.severity_counts(findings).crossJoin(self.files().agg(F.count(F.lit(1)).alias("__files")))  # one row each
        return rollups.gate(rollups.quality_score(counts, F.col("__files")), c.most_high, c.most_medium, c.least_score).drop("__files")
