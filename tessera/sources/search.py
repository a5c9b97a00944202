"""Search engines as Spark data sources: a registered function of (query, number) becomes a readable format."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENGINES: dict[str, Callable[[str, int], Iterable[dict]]] = {}
LIMITS = {"title": 1_000_000, "url": 8_192, "content": 1_000_000}


def register_engine(name: str, search: Callable[[str, int], Iterable[dict]]) -> None:
    ENGINES[name] = search


class SearchReader(DataSourceReader):
    def __init__(self, engine: Callable[[str, int], Iterable[dict]], options: dict):
        self.engine = engine
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        self.number = int(options.get("number", "5"))

    def partitions(self):
        return [InputPartition(q) for q in self.queries]

    def read(self, partition):
        """A failing engine gives one row with the error, never a failed job."""
        try:
            for pos, hit in enumerate(self.engine(partition.value, self.number)):
                if pos < self.number and isinstance(hit, dict):
                    yield (partition.value, pos, *(str(hit.get(k) or "")[:n] for k, n in LIMITS.items()), float(hit.get("score") or 0.0), None)
        except Exception as e:
            yield (partition.value, 0, None, None, None, None, repr(e))


def source_of(name: str) -> type[DataSource]:
    """A source class that carries its engine, since executors don't have the driver's registry."""
    engine, reader = ENGINES[name], SearchReader

    class SearchSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"tessera_search_{name}"

        def schema(self) -> str:
            return "query string, pos int, title string, url string, content string, score double, error string"

        def reader(self, schema):
            return reader(engine, self.options)

    return SearchSource


def search(spark: SparkSession, engine: str, queries: list[str], number: int = 5):
    """Hits of each query, at most `number`, in the engine's order."""
    spark.dataSource.register(source_of(engine))
    return spark.read.format(f"tessera_search_{engine}").option("queries", "\n".join(queries)).option("number", str(number)).load()
