"""Source registry, artifact cache with provenance, and a polite client with injected fetchers.

All of it runs on the driver: it lands raw payloads as files, which Spark then reads in bulk.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fetcher = Callable[[str, dict, dict], tuple[int, bytes]]


class FetchBlocked(RuntimeError):
    """Policy doesn't allow the request."""


class FetchError(RuntimeError):
    """The request failed for good."""


class MissingKey(RuntimeError):
    """The source needs a key."""


@dataclass(frozen=True)
class Source:
    """A vetted source; an enabled network source needs a licence and a rate."""

    id: str
    kind: str
    base_url: str
    license: str
    rate_limit_per_min: float = 0
    enabled: bool = False
    scraping_allowed: bool = False
    requires_key: bool = False
    attribution_required: bool = False
    coverage: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ("api", "open_dataset", "scrape"):
            raise ValueError(f"{self.id}: kind {self.kind}")
        if self.license is None or self.license.strip().upper() in ("", "UNKNOWN"):
            raise ValueError(f"{self.id}: no known licence")
        if self.enabled and self.kind != "open_dataset" and self.rate_limit_per_min <= 0:
            raise ValueError(f"{self.id}: enabled without a rate")

    @property
    def min_interval_s(self) -> float:
        return 60.0 / self.rate_limit_per_min if self.rate_limit_per_min > 0 else 0.0


#: Where the registry of sources is looked for.
SOURCES = Path("configs/sources.yaml")


def load_sources(path: str | Path = SOURCES) -> dict[str, Source]:
    """Sources by id from a YAML file; an id that occurs twice, or no such file, is an error."""
    import yaml

    if not Path(path).is_file():
        raise FileNotFoundError(f"no registry of sources at {path}")
    known, out = set(Source.__dataclass_fields__), {}
    for entry in yaml.safe_load(Path(path).read_text())["sources"]:
        s = Source(**{k: tuple(v) if k == "coverage" else v for k, v in entry.items() if k in known})
        if s.id in out:
            raise ValueError(f"duplicate source {s.id}")
        out[s.id] = s
    return out


def get_source(sources: dict[str, Source], name: str) -> Source:
    if name not in sources:
        raise KeyError(name)
    return sources[name]


def cache_key(url: str, params: dict | None = None) -> str:
    """24 hex digits of a hash of the URL and its parameters in order."""
    query = "&".join(f"{k}={v}" for k, v in sorted((params or {}).items()))
    return hashlib.sha256((f"{url}?{query}" if query else url).encode()).hexdigest()[:24]


def cache_key_column(url: Column, params: Column) -> Column:
    """``cache_key`` of a URL and a map column."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    query = F.array_join(pairs, "&")
    return F.substring(F.sha2(F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.concat(url, F.lit("?"), query)).otherwise(url), 256), 1, 24)


@dataclass
class Provenance:
    source: str
    url: str
    params: dict
    sha256: str
    license: str
    n_bytes: int = 0
    attribution_required: bool = False
    fetched_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def provenance(source: Source, url: str, params: dict, content: bytes) -> Provenance:
    return Provenance(source.id, url, params, hashlib.sha256(content).hexdigest(), source.license, len(content), source.attribution_required)


class FileCache:
    """Payloads and their provenance by key, a folder for each source; on the driver, which lands them.

    Point it at a mounted folder that executors share where Spark is to read them in bulk.
    """

    def __init__(self, folder: str | Path, extension: str = "bin"):
        self.folder, self.extension = Path(folder), extension.lstrip(".")

    def path(self, source: str, key: str) -> Path:
        return self.folder / source / f"{key}.{self.extension}"

    def get(self, source: str, key: str) -> bytes | None:
        path = self.path(source, key)
        return path.read_bytes() if path.exists() else None

    def put(self, source: str, key: str, content: bytes, provenance: Provenance) -> Path:
        path = self.path(source, key)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        (path.parent / f"{key}.prov.json").write_text(provenance.to_json())
        return path


def http_fetcher(headers: dict[str, str] | None = None, timeout: float = 30.0, agent: str = "plumbline") -> Fetcher:
    """A fetcher over HTTP by the standard library; a status that isn't 200 is returned, not raised."""
    own = {"User-Agent": agent} | (headers or {})

    def fetch(url: str, params: dict, more: dict) -> tuple[int, bytes]:
        from urllib.error import HTTPError
        from urllib.parse import urlencode
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(f"{url}?{urlencode(params)}" if params else url, headers=own | more), timeout=timeout) as answer:
                return answer.status, answer.read()
        except HTTPError as e:
            return e.code, e.read()

    return fetch


def landed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Landed payloads, a file a row: path and value."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("wholetext", True).text(folder).withColumn("path", F.input_file_name())


def provenance_table(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "*.prov.json").select("path", F.from_json("value", "struct<source:string,url:string,params:map<string,string>,sha256:string,license:string,n_bytes:long,attribution_required:boolean,fetched_at:string>").alias("p")).select("path", "p.*")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 of each payload in a folder, by Spark's binary reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(~F.col("path").endswith(".prov.json")).select("path", F.sha2("content", 256).alias("sha256"))


class RateLimiter:
    """At least ``interval`` seconds between calls; clock and sleep can be injected."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.interval - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()


class Robots:
    """Whether robots.txt allows a URL; what can't be read is not allowed."""

    def __init__(self, fetch: Fetcher, agent: str = "plumbline"):
        self.fetch, self.agent, self.known = fetch, agent, {}

    def allowed(self, url: str) -> bool:
        host = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if host not in self.known:
            try:
                status, body = self.fetch(f"{host}/robots.txt", {}, {})
                parser = RobotFileParser()
                parser.parse(body.decode("utf-8", "replace").splitlines() if status == 200 else ["User-agent: *", "Disallow: /"])
                self.known[host] = parser
            except Exception:  # noqa: BLE001 - closed on any failure
                self.known[host] = None
        parser = self.known[host]
        return parser is not None and parser.can_fetch(self.agent, url)


class PoliteClient:
    """Cache, then policy, then a request with retries (429, 5xx, network), then the cache again."""

    RETRIED = (429, 500, 502, 503, 504)

    def __init__(self, source: Source, cache: FileCache, fetch: Fetcher, robots: Robots | None = None, limiter: RateLimiter | None = None, tries: int = 4, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.source, self.cache, self.fetch, self.robots = source, cache, fetch, robots
        self.limiter = limiter or RateLimiter(source.min_interval_s, sleep=sleep)
        self.tries, self.backoff, self.sleep = tries, backoff, sleep

    def _allow(self, url: str) -> None:
        if not self.source.enabled:
            raise FetchBlocked(f"{self.source.id} is not enabled")
        if self.source.kind == "scrape" and (not self.source.scraping_allowed or self.robots is None or not self.robots.allowed(url)):
            raise FetchBlocked(f"{url} must not be scraped")

    def get(self, url: str, params: dict | None = None, headers: dict | None = None) -> bytes:
        key = cache_key(url, params)
        if (held := self.cache.get(self.source.id, key)) is not None:
            return held
        self._allow(url)
        body = self._tried(url, params or {}, headers or {})
        self.cache.put(self.source.id, key, body, provenance(self.source, url, params or {}, body))
        return body

    def _tried(self, url: str, params: dict, headers: dict) -> bytes:
        why = ""
        for k in range(self.tries):
            if k:
                self.sleep(self.backoff * 2 ** (k - 1))
            self.limiter.wait()
            try:
                status, body = self.fetch(url, params, headers)
            except Exception as e:  # noqa: BLE001 - a fetcher has errors of its own; all are tried again
                why = str(e)
                continue
            if status == 200:
                return body
            why = f"status {status}"
            if status not in self.RETRIED:
                break
        raise FetchError(f"{url}: {why}")


class StatsIngester:
    """Cached endpoints of the statistics source; ``produce(endpoint, params)`` gives a payload."""

    EMPTY = json.dumps({"resultSets": [{"headers": [], "rowSet": []}]})

    def __init__(self, cache: FileCache, produce: Callable[[str, dict], str], source: Source, limiter: RateLimiter | None = None):
        self.cache, self.produce, self.source = cache, produce, source
        self.limiter = limiter or RateLimiter(source.min_interval_s)

    def _cached(self, endpoint: str, params: dict, safe: bool = False) -> str:
        key = cache_key(f"{self.source.base_url}/{endpoint}", params)
        if (held := self.cache.get(self.source.id, key)) is not None:
            return held.decode()
        self.limiter.wait()
        try:
            text = self.produce(endpoint, params)
        except Exception:  # noqa: BLE001 - one player's failure is an empty payload
            if not safe:
                raise
            text = self.EMPTY
        self.cache.put(self.source.id, key, text.encode(), provenance(self.source, endpoint, params, text.encode()))
        return text

    def draft_history(self, year: int) -> str:
        return self._cached("drafthistory", {"season": year})

    def draft_combine(self, season: str) -> str:
        return self._cached("draftcombinestats", {"season": season})

    def player_info(self, player_id: int) -> str:
        return self._cached("commonplayerinfo", {"player_id": player_id}, safe=True)

    def player_awards(self, player_id: int) -> str:
        return self._cached("playerawards", {"player_id": player_id}, safe=True)

    def player_season(self, season: str, measure: str = "Base") -> str:
        return self._cached("leaguedashplayerstats", {"season": season, "measure": measure})


class CollegeIngester:
    """Endpoints of the college source behind a bearer key."""

    def __init__(self, client: PoliteClient, key: str | None):
        if not key:
            raise MissingKey(client.source.id)
        self.client, self.headers = client, {"Authorization": f"Bearer {key}"}

    def _get(self, path: str, **params) -> str:
        return self.client.get(f"{self.client.source.base_url}{path}", params, self.headers).decode()

    def player_season(self, season: int) -> str:
        return self._get("/stats/player/season", season=season)

    def teams(self) -> str:
        return self._get("/teams")

    def roster(self, season: int, team: str) -> str:
        return self._get("/teams/roster", season=season, team=team)


class AbroadIngester:
    """Season records from abroad; a season that isn't there yet is empty and not cached."""

    def __init__(self, cache: FileCache, records: Callable[[int], list[dict]], source: Source):
        self.cache, self.records, self.source = cache, records, source

    def player_season(self, season: int) -> str:
        key = cache_key(f"{self.source.base_url}/players", {"season": season})
        if (held := self.cache.get(self.source.id, key)) is not None:
            return held.decode()
        try:
            text = json.dumps(self.records(season))
        except FetchError as e:
            if "404" in str(e):
                return "[]"
            raise
        self.cache.put(self.source.id, key, text.encode(), provenance(self.source, "players", {"season": season}, text.encode()))
        return text


def stats_producer(fetch: Fetcher, source: Source) -> Callable[[str, dict], str]:
    """What ``StatsIngester`` asks for a payload: an endpoint under the source's address."""

    def produce(endpoint: str, params: dict) -> str:
        status, body = fetch(f"{source.base_url}/{endpoint}", params, {})
        if status != 200:
            raise FetchError(f"{endpoint}: status {status}")
        return body.decode()

    return produce


def season_label(year: int) -> str:
    return f"{year}-{(year + 1) % 100:02d}"
