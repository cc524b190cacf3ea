"""Fetching and hashing files inside tasks, with an injected transport; nothing here opens a network by itself."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WAIT, MAX_RETRY_AFTER = 30.0, 300.0
_OUT = "repo_path string, download_ok boolean, sha256_match boolean, size_bytes long, sha256 string, attempts int, error string"


class TooManyRequests(Exception):
    """The server asks to wait; retry_after in seconds where it says so."""

    def __init__(self, retry_after: float | None = None) -> None:
        super().__init__("too many requests")
        self.retry_after = retry_after


class HostCredential:
    """A token that goes to one https host only: other hosts, other schemes and redirect targets get none."""

    def __init__(self, host: str, token: str | None) -> None:
        self.host, self._token = host.lower(), token

    def headers(self, url: str, redirected: bool = False) -> dict[str, str]:
        parts = urlsplit(url)
        mine = parts.scheme == "https" and parts.hostname == self.host and parts.port in (None, 443) and parts.username is None
        return {"Authorization": f"Bearer {self._token}"} if self._token and mine and not redirected else {}

    def __repr__(self) -> str:
        return f"HostCredential({self.host!r}, {'set' if self._token else 'unset'})"


def download(spark, get: Callable[[str], bytes], name: str, out: str, want: str | None = None, retries: int = 4) -> dict:
    """Fetch one file at the revision that get is bound to, check its hash and put it into place whole."""
    kept: list[bytes] = []

    def keep(path: str) -> bytes:
        kept[:] = [get(path)]
        return kept[0]

    got = fetch_once(keep, name, want, retries)
    if not got["download_ok"] or got["sha256_match"] is False:
        raise OSError(f"{name}: {got['error'] or 'the hash differs'}")
    from quern.sources.sinks import write_bytes

    write_bytes(spark, out, kept[0])
    return got


def wait_seconds(attempt: int, retry_after: float | None = None) -> float:
    """Pause before the next attempt (from 0): doubling up to 30 s, or what the server asks for, up to 300 s."""
    return min(float(2**attempt), MAX_WAIT) if retry_after is None else min(retry_after, MAX_RETRY_AFTER)


def fetch_once(get: Callable[[str], bytes], path: str, want: str | None, retries: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Fetch with retries and check the hash; never raises. A wrong hash is a failed match, not a retry."""
    error = ""
    for attempt in range(retries + 1):
        try:
            body = get(path)
        except TooManyRequests as e:
            error = str(e)
            pause = wait_seconds(attempt, e.retry_after)
        except Exception as e:  # any transport's errors become rows
            error = f"{type(e).__name__}: {e}"
            pause = wait_seconds(attempt)
        else:
            got = hashlib.sha256(body).hexdigest()
            return {"repo_path": path, "download_ok": True, "sha256_match": None if want is None else got == want, "size_bytes": len(body), "sha256": got, "attempts": attempt + 1, "error": ""}
        if attempt < retries:
            sleep(pause)
    return {"repo_path": path, "download_ok": False, "sha256_match": None, "size_bytes": None, "sha256": None, "attempts": retries + 1, "error": error}


def fetch_all(files: DataFrame, get: Callable[[str], bytes], retries: int = 4) -> DataFrame:
    """One row per file (repo_path, sha256): outcome, size and hash. A task holds one file at a time and one small frame of outcomes per batch."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [fetch_once(get, path, want if isinstance(want, str) else None, retries) for path, want in zip(pdf["repo_path"], pdf["sha256"])]
            if rows:
                yield pd.DataFrame(rows).astype({"size_bytes": "Int64", "sha256_match": "boolean"})

    return files.select("repo_path", "sha256").mapInPandas(work, _OUT)


def decoded_rate(frames: DataFrame) -> DataFrame:
    """repo_path, decoded_frames, decoded_fps = (n - 1) / (last - first) from the frames' times; null where undefined."""
    g = frames.groupBy("repo_path").agg(F.count(F.lit(1)).alias("decoded_frames"), (F.max("t") - F.min("t")).alias("_span"))
    return g.select("repo_path", "decoded_frames", F.when(F.col("_span") > 0, (F.col("decoded_frames") - 1) / F.col("_span")).alias("decoded_fps"))


def adopt(old: DataFrame, wanted: DataFrame, key: str, origin: str) -> DataFrame:
    """Rows of an earlier run that are still wanted, tagged with where they come from."""
    return old.join(wanted.select(key).distinct(), key, "left_semi").withColumn("probe_origin", F.lit(origin))


def estimate(todo: DataFrame, measured: DataFrame, size: str, default_bytes: float, per_minute: float, least: int = 20) -> DataFrame:
    """clips, bytes, minutes, basis of a run: the measured mean size once there are enough measured rows."""
    m = measured.agg(F.count(size).alias("k"), F.avg(size).alias("mean"))
    t = todo.agg(F.count(F.lit(1)).alias("clips")).crossJoin(m)
    known = F.col("k") >= least
    return t.select("clips", (F.col("clips") * F.when(known, F.col("mean")).otherwise(F.lit(float(default_bytes)))).alias("bytes"), (F.col("clips") / F.lit(float(per_minute))).alias("minutes"), F.when(known, "measured").otherwise("theoretical").alias("basis"))
