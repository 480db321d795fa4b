"""Map tiles as a Python data source: as many partitions as may fetch at a time, one rate over all of them, null data where a tile cannot be had."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tile servers by name (URL template, attribution, largest zoom).
SERVERS = {
    "esri_satellite": ("https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/{z}/{y}/{x}", "ESRI World Imagery", 19),
    "esri_streets": ("https://server.arcgisonline.com/ArcGIS/rest/services/World_Street_Map/MapServer/tile/{z}/{y}/{x}", "ESRI World Street Map", 19),
    "osm": ("https://tile.openstreetmap.org/{z}/{x}/{y}.png", "OpenStreetMap", 19),
    "carto_light": ("https://cartodb-basemaps-a.global.ssl.fastly.net/light_all/{z}/{x}/{y}.png", "CartoDB", 19),
}


def servers(spark: SparkSession):
    """The registry as rows: server, url, attribution, max_zoom."""
    return spark.createDataFrame([(k, *v) for k, v in SERVERS.items()], "server string, url string, attribution string, max_zoom int")


def with_urls(tiles: DataFrame) -> DataFrame:
    """tiles (server, zoom, x, y) with the url of each; null for a server that the registry (broadcast, four rows) lacks."""
    out = tiles.join(F.broadcast(servers(tiles.sparkSession).select("server", F.col("url").alias("_t"))), "server", "left")
    for name, c in (("{z}", "zoom"), ("{y}", "y"), ("{x}", "x")):
        out = out.withColumn("_t", F.replace("_t", F.lit(name), F.col(c).cast("string")))
    return out.withColumnRenamed("_t", "url")


class TileRun(InputPartition):
    """Every slots-th tile of the area, from the one of number `slot`."""

    def __init__(self, slot: int) -> None:
        self.slot = slot


class TileReader(DataSourceReader):
    """Options: rate, requests a second over all tasks (or pause, seconds for ten of them), and slots, tasks that fetch at a time. A task keeps to its share of the rate by the
    clock, so that all together keep to the whole, however many cores there are."""

    def __init__(self, options) -> None:
        self.template = SERVERS[options["server"]][0] if "server" in options else options["template"]
        self.timeout = float(options.get("timeout", 30))
        pause = float(options.get("pause", 0.1))
        self.rate = float(options["rate"]) if "rate" in options else 10 / pause if pause else 0.0
        self.zoom = int(options["zoom"])
        self.x = (int(options["min_x"]), int(options["max_x"]))
        self.y = (int(options["min_y"]), int(options["max_y"]))
        self.slots = max(1, min(int(options.get("slots", 4)), self._tiles()))

    def _tiles(self) -> int:
        return (self.x[1] - self.x[0] + 1) * (self.y[1] - self.y[0] + 1)

    def partitions(self) -> list[InputPartition]:
        return [TileRun(k) for k in range(self.slots)]

    def read(self, partition: TileRun) -> Iterator[tuple]:
        wide = self.x[1] - self.x[0] + 1
        due = time.monotonic()
        for k in range(partition.slot, self._tiles(), self.slots):
            if self.rate:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + self.slots / self.rate
            x, y = self.x[0] + k % wide, self.y[0] + k // wide
            url = self.template.replace("{z}", str(self.zoom)).replace("{y}", str(y)).replace("{x}", str(x))
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as got:  # noqa: S310
                    data = got.read()
            except OSError:
                data = None
            yield self.zoom, x, y, data


class TileSource(DataSource):
    """spark.read.format("tiles") with options template (or server), zoom, min_x, max_x, min_y, max_y."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return "zoom int, x int, y int, data binary"

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def register(spark: SparkSession) -> None:
    from laneatlas.session import ship

    ship(spark)
    spark.dataSource.register(TileSource)
