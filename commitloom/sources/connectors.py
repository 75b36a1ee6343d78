"""Python data sources: repository search results and git logs.

``repo_search`` reads search results that were saved as JSON, or asks a search service,
one partition per query in priority order. ``git_log`` reads local clones, one partition
per slice of a repository's history: the commits of a range with the text of their
changes, one row per commit and file, streamed from git. ``clone_repositories`` makes such clones.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import shutil
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.instants import to_instant
from ..schemas import MINED, REPO_CANDIDATE

# Search terms in order of priority; {stars} stands for the threshold.
SEARCH_TERMS = (
    "language:Terraform stars:>={stars}", "terraform stars:>={stars}", "topic:terraform stars:>={stars}", "filename:.tf stars:>={stars}", "language:HCL stars:>={stars}",
    "terraform", "language:Terraform", "topic:terraform", "filename:.tf", "language:HCL",
)


class _Part(InputPartition):
    def __init__(self, value):
        super().__init__(value)


class RepoSearch(DataSource):
    """``path``: a folder of JSON lists, one file per query; rows have the query's priority (its place in name order).

    With ``endpoint`` instead, the search service there is asked for SEARCH_TERMS
    (``stars``: their threshold, ``limit``: repositories a term, ``token``: of the service).
    """

    @classmethod
    def name(cls) -> str:
        return "repo_search"

    def schema(self) -> str:
        return REPO_CANDIDATE + ", priority INT, position INT"

    def reader(self, schema) -> DataSourceReader:
        return _SearchServiceReader(self.options) if self.options.get("endpoint") else _RepoSearchReader(self.options)


class _RepoSearchReader(DataSourceReader):
    def __init__(self, options):
        self.files = sorted(str(p) for p in Path(options["path"]).glob("*.json"))

    def partitions(self):
        return [_Part((i, f)) for i, f in enumerate(self.files)]

    def read(self, partition) -> Iterator[tuple]:
        priority, file = partition.value
        try:
            found = json.loads(Path(file).read_text(encoding="utf-8"))
        except ValueError:
            found = []  # a damaged dump gives nothing, the others still count
        for k, r in enumerate(found):
            yield r.get("repo_full_name"), r.get("stars"), r.get("forks"), r.get("commits") or 0, priority, k


class SearchService:
    """Requests to a search service that tells its rate limit in headers (``X-RateLimit-Remaining``, ``X-RateLimit-Reset``)."""

    def __init__(self, endpoint: str, token: str = "", least: int = 10, tries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.endpoint, self.token, self.least, self.tries, self.sleep = endpoint.rstrip("/"), token, least, tries, sleep

    def _wait(self, headers) -> bool:
        """Sleep until five seconds after the limit's reset if few requests are left; whether that was so."""
        left, reset = headers.get("X-RateLimit-Remaining"), headers.get("X-RateLimit-Reset")
        if left is None or int(left) >= self.least:
            return False
        self.sleep(max(1.0, float(reset or 0) - time.time() + 5))
        return True

    def get(self, path: str, **query: object) -> tuple[object, object]:
        """(parsed answer, headers); tried again after a pause while the limit is exceeded."""
        url = f"{self.endpoint}{path}?{urllib.parse.urlencode(query)}"
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
                    body = json.loads(r.read() or b"null")
                    self._wait(r.headers)
                    return body, r.headers
            except urllib.error.HTTPError as e:
                if e.code not in (403, 429) or attempt == self.tries:
                    raise
                if not self._wait(e.headers):
                    self.sleep(float(attempt))
        raise RuntimeError("no try was allowed")

    def commit_count(self, full_name: str) -> int:
        """Commits of a repository, from the number of the last page of one commit each; 0 if it can't be found out."""
        try:
            body, headers = self.get(f"/repos/{full_name}/commits", per_page=1)
        except (OSError, ValueError):
            return 0
        last = re.search(r"[?&]page=(\d+)[^>]*>; rel=\"last\"", headers.get("Link") or "")
        return int(last[1]) if last else len(body or [])


class _SearchServiceReader(DataSourceReader):
    def __init__(self, options):
        self.endpoint, self.token = options["endpoint"], options.get("token", "")
        self.stars, self.limit = int(options.get("stars", 10)), int(options.get("limit", 50))

    def partitions(self):
        return [_Part((i, t.format(stars=self.stars))) for i, t in enumerate(SEARCH_TERMS)]

    def read(self, partition) -> Iterator[tuple]:
        priority, term = partition.value
        service, k, page = SearchService(self.endpoint, self.token), 0, 1
        while k < self.limit:
            try:
                body, _ = service.get("/search/repositories", q=term, sort="stars", order="desc", per_page=min(100, self.limit), page=page)
            except (OSError, ValueError):
                return  # a query that fails gives nothing more, the others still count
            items = (body or {}).get("items") or []
            for r in items[: self.limit - k]:
                yield r.get("full_name"), r.get("stargazers_count"), r.get("forks_count"), service.commit_count(r.get("full_name")), priority, k
                k += 1
            if not items:
                return
            page += 1


class GitLog(DataSource):
    """``repos``: paths of clones between commas; ``suffix``: of the files to read; ``slice``: commits a partition (2,000).

    ``since``: a revision to start after, or a JSON object with one for each clone's name;
    a revision that a clone does not have reads all of it. ``patch_kind``: ``diff``,
    ``empty`` (a change without text), ``content`` (whole changed files, where the clone
    lacks what a diff needs), ``tree`` (all files of the commit, where it lacks even
    that), ``failed`` (nothing could be read: one row with the clone's name, and the
    commit if it is known). What fails leaves the rest alone.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return MINED + ", patch_kind STRING"

    def reader(self, schema) -> DataSourceReader:
        return _GitLogReader(self.options)


_ENTRY = "\x01\x1e\x01"
_FORMAT = "--format=%x01%x1e%x01%H%x00%an%x00%cI%x00%B%x02"


def _git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", path, *args], capture_output=True, check=True, stdin=subprocess.DEVNULL).stdout.decode("utf-8", errors="ignore")


def _entries(path: str, args: list[str], chunk: int = 1 << 20) -> Iterator[str]:
    """Entries of a log as git writes them, one in memory at a time; CalledProcessError at the end if git failed, without the unfinished entry."""
    cmd = ["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-c", "log.showRoot=true", "-C", path, "log", "--no-color", *args]
    with subprocess.Popen(cmd, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL) as git:
        decode = codecs.getincrementaldecoder("utf-8")(errors="ignore").decode
        parts: list[str] = []
        tail = ""  # may be the start of a separator
        while data := git.stdout.read(chunk):
            *done, rest = (tail + decode(data)).split(_ENTRY)
            for piece in done:
                if entry := "".join([*parts, piece]):
                    yield entry
                parts = []
            keep = len(_ENTRY) - 1
            parts.append(rest[:-keep])
            tail = rest[-keep:]
        if git.wait():
            raise subprocess.CalledProcessError(git.returncode, cmd)
        if entry := "".join([*parts, tail]):
            yield entry


class _GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.since, self.suffix, self.slice = options.get("since", ""), options.get("suffix", ""), int(options.get("slice", 2000))

    def _span(self, path: str) -> str:
        since = json.loads(self.since).get(Path(path).name, "") if self.since.startswith("{") else self.since
        try:
            return f"{since}..HEAD" if since and _git(path, "rev-parse", "--verify", "--quiet", f"{since}^{{commit}}") else "HEAD"
        except subprocess.CalledProcessError:  # the revision is gone: everything
            return "HEAD"

    def partitions(self):
        out = []
        for path in self.repos:
            try:
                span = self._span(path)
                n = int(_git(path, "rev-list", "--first-parent", "--count", span))
                out += [_Part((path, span, k)) for k in range(0, n, self.slice)]
            except (subprocess.CalledProcessError, OSError):
                out.append(_Part((path, "", 0)))
        return out or [_Part(("", "", 0))]

    def read(self, partition) -> Iterator[tuple]:
        path, span, skip = partition.value
        if not path:
            return
        name = Path(path).name
        if not span:
            yield name, None, None, None, None, None, None, None, "failed"
            return
        head = _git(path, "rev-parse", "HEAD").strip()
        part, seen = ["--first-parent", f"--skip={skip}", f"--max-count={self.slice}", span], set()
        try:
            for entry in _entries(path, [_FORMAT, "-p", "--unified=3", *part]):
                meta, _, diff = entry.partition("\x02")
                commit, author, date, message = meta.split("\x00", 3)
                seen.add(commit)
                for change in diff.split("\ndiff --git ")[1:]:
                    header, at, hunks = change.partition("\n@@")
                    file = header.split("\n", 1)[0].rpartition(" b/")[2]
                    if file.endswith(self.suffix):
                        yield name, commit, author, date, message.strip("\n"), file, "@@" + hunks.rstrip("\n") if at else "", head, "diff" if at else "empty"
        except subprocess.CalledProcessError:  # objects are missing: the other commits one by one
            for commit in _git(path, "rev-list", *part).split():
                if commit not in seen:
                    yield from self._without_diff(path, commit, head)

    def _without_diff(self, path: str, commit: str, head: str) -> Iterator[tuple]:
        """A commit's changed files as they are after it, or else all its files."""
        name = Path(path).name
        try:
            author, date, message = _git(path, "log", "-1", "--no-patch", "--format=%an%x00%cI%x00%B", commit).split("\x00", 2)
        except subprocess.CalledProcessError:
            yield name, commit, None, None, None, None, None, head, "failed"
            return
        for kind, args in (("diff", ("diff-tree", "--root", "--no-commit-id", "-r", "-p", "--unified=3", "--first-parent", commit)), ("content", ("diff-tree", "--root", "--no-commit-id", "-r", "--name-only", commit)), ("tree", ("ls-tree", "-r", "--name-only", commit))):
            try:
                listed = _git(path, *args)
            except subprocess.CalledProcessError:
                continue
            if kind == "diff":
                for change in ("\n" + listed).split("\ndiff --git ")[1:]:
                    header, at, hunks = change.partition("\n@@")
                    file = header.split("\n", 1)[0].rpartition(" b/")[2]
                    if file.endswith(self.suffix):
                        yield name, commit, author, date, message.strip("\n"), file, "@@" + hunks.rstrip("\n") if at else "", head, "diff" if at else "empty"
                return
            for file in listed.split("\n"):
                if file and file.endswith(self.suffix):
                    try:
                        content = _git(path, "show", f"{commit}:{file}")
                    except subprocess.CalledProcessError:
                        content = ""  # a removed or missing file
                    yield name, commit, author, date, message.strip("\n"), file, content, head, kind
            return
        yield name, commit, author, date, message.strip("\n"), None, None, head, "failed"


def resume_points(mined: DataFrame) -> DataFrame:
    """``repo, last_head, last_updated, total_commits_processed``: where each repository's next scan starts, from its mined records.

    The head is that of the records with the latest date; undated records come first.
    """
    rows = mined.where((F.col("repo") != "") & F.col("head_hash").isNotNull())
    return rows.groupBy("repo").agg(
        F.max_by("head_hash", F.struct(to_instant(F.col("date")).alias("ts"), "head_hash")).alias("last_head"), F.max(to_instant(F.col("date"))).alias("last_updated"), F.count_distinct("commit_hash").alias("total_commits_processed")
    )


def resume_option(points: DataFrame) -> str:
    """The ``since`` option of ``git_log`` for :func:`resume_points`, one entry a repository to be scanned."""
    return json.dumps({r.repo: r.last_head for r in points.select("repo", "last_head").collect()})


def clone_one(full_name: str, url: str, folder: str, depth: int | None, retries: int, delay: float) -> tuple[str | None, str, str | None]:
    """(path, status, reason) of one clone: fetched if the folder already holds it, else cloned without blobs, with growing pauses between tries."""
    owner, _, name = full_name.partition("/")
    path = Path(folder) / f"{owner}_{name[:50]}_{hashlib.md5(full_name.encode()).hexdigest()[:8]}"
    reason = None
    for attempt in range(1, retries + 1):
        try:
            if (path / ".git").is_dir() and _git(str(path), "remote", "get-url", "origin").strip() == url:
                _git(str(path), "fetch", "--quiet", "origin")
            else:
                shutil.rmtree(path, ignore_errors=True)
                path.parent.mkdir(parents=True, exist_ok=True)
                _git(str(path.parent), "clone", "--quiet", *(["--depth", str(depth)] if depth else ["--filter=blob:none"]), url, str(path))
            return str(path), "success", None
        except (subprocess.CalledProcessError, OSError) as e:
            reason = (getattr(e, "stderr", b"") or str(e).encode()).decode(errors="ignore").strip()[:300]
            time.sleep(delay * attempt)
    return None, "clone_failed", reason


def clone_repositories(df: DataFrame, name: str, base_url: str, folder: str, depth: int | None = None, retries: int = 3, delay: float = 2.0) -> DataFrame:
    """``repo, path, status, reason`` of each distinct repository, cloned into a folder that the executors share; failures are rows."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = [clone_one(r, f"{base_url.rstrip('/')}/{r}", folder, depth, retries, delay) for r in pdf["repo"]]
            yield pd.DataFrame({"repo": pdf["repo"], "path": [d[0] for d in done], "status": [d[1] for d in done], "reason": [d[2] for d in done]})

    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("repo")).distinct()
    return names.mapInPandas(run, "repo string, path string, status string, reason string")


def register(spark: SparkSession) -> None:
    """Make ``repo_search`` and ``git_log`` known to a session."""
    spark.dataSource.register(RepoSearch)
    spark.dataSource.register(GitLog)
