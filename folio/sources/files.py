"""Folders as a Spark source: names and stat only, bytes read later.

``spark.read.format("folio_files").option("paths", json list)``.  A root is walked by one partition for
each folder right below it and one for its own files, so a huge root is not one task.  Entries of a
partition come sorted by name, ``.git`` is never entered, links and special files are left out
unless links are followed, ignore files are honoured (those of the folders above the root, of
the repository and of the user too; last match wins, '!' takes back), and excluded folders are
never opened.  A folder that cannot be read is a row with a warning and nothing else.
"""

from __future__ import annotations

import errno
import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folio.functions import classify, paths
from folio.options import Options

SCHEMA = "id string, relative string, root_relative string, absolute string, root_idx int, size bigint, modified_ns bigint, is_symlink boolean, dev bigint, ino bigint, is_root boolean, warning string"


def _glob(pattern: str) -> str:
    """Body of a gitignore pattern: '*' and '?' stay inside a folder."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            i += pattern[i] == "\\" and i + 1 < len(pattern)
            out.append(re.escape(pattern[i]))
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    rx: re.Pattern[str]
    keep: bool
    dirs_only: bool


def rules(text: str) -> list[Rule]:
    """Rules of an ignore file, in order."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        body = line[keep:]
        dirs = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        if body:
            out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + _glob(body) + r"\Z", re.S), keep, dirs))
    return out


Chain = list[tuple[str, list[Rule]]]  # (folder under the root, its rules); '^x/' is a folder above, x/ below it


def _verdict(chain: Chain, relative: str, is_dir: bool) -> bool | None:
    """What the innermost rule that matches says: left out, kept, or nothing."""
    for base, own in reversed(chain):
        inner = base[1:] + relative if base.startswith("^") else relative[len(base) :]
        for r in reversed(own):
            if (is_dir or not r.dirs_only) and r.rx.match(inner):
                return not r.keep
    return None


def ignored(chain: Chain, relative: str, is_dir: bool) -> bool:
    """Whether the rules of the folders above (outermost first) leave the path out."""
    return bool(_verdict(chain, relative, is_dir))


def _rules_of(path: str) -> list[Rule]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return rules(f.read())
    except OSError:
        return []


@dataclass(frozen=True)
class Ignores:
    """Rules that hold in a folder, strongest first: .ignore files, .gitignore files of the
    repository, its info/exclude, the user's own.  Without a repository only the first hold."""

    plain: tuple = ()
    git: tuple = ()
    exclude: tuple = ()
    user: tuple = ()
    in_git: bool = False

    def enter(self, folder: str, base: str) -> Ignores:
        """With the rules of a folder; a repository of its own ends those of the one around it."""
        plain = (*self.plain, (base, _rules_of(os.path.join(folder, ".ignore"))))
        own = os.path.exists(os.path.join(folder, ".git"))
        git = (*(() if own else self.git), (base, _rules_of(os.path.join(folder, ".gitignore"))))
        exclude = ((base, _rules_of(os.path.join(folder, ".git", "info", "exclude"))),) if own else self.exclude
        return Ignores(plain, git, exclude, self.user, self.in_git or own)

    def drops(self, relative: str, is_dir: bool) -> bool:
        for chain in (self.plain, *((self.git, self.exclude, self.user) if self.in_git else ())):
            said = _verdict(list(chain), relative, is_dir)
            if said is not None:
                return said
        return False

    @staticmethod
    def above(root: str, user: str = "") -> Ignores:
        """Rules of the folders above a root and of the user."""
        out = Ignores(user=(("", rules(user)),))
        parts = [p for p in os.path.abspath(root).split("/") if p]
        for k in range(len(parts)):
            out = out.enter("/" + "/".join(parts[:k]), "^" + "".join(f"{p}/" for p in parts[k:]))
        return out


def escaped(name: str) -> str:
    """A file name as text; bytes that are no UTF-8 as \\xNN."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def labels(roots: list[str]) -> list[str]:
    """Shortest distinguishing tails of the roots' paths, none of them a prefix of another."""
    split = [[p for p in os.path.abspath(r).split("/") if p] or ["root"] for r in roots]
    sizes = [1] * len(roots)
    while True:
        tails = ["/".join(s[-n:]) for s, n in zip(split, sizes)]
        clash = {i for i, a in enumerate(tails) for j, b in enumerate(tails) if i != j and (a == b or b.startswith(a + "/") or a.startswith(b + "/"))}
        grow = [i for i in clash if sizes[i] < len(split[i])]
        if not grow:
            return [t if tails.index(t) == i else f"{t}-{i}" for i, t in enumerate(tails)]
        for i in grow:
            sizes[i] += 1


def check_roots(roots: list[str]) -> None:
    for r in roots:
        if not os.path.exists(r):
            raise ValueError(f"{r} does not exist")
        if not (os.path.isdir(r) or os.path.isfile(r)):
            raise ValueError(f"{r} is not a file or directory")


def user_ignore() -> str:
    """The ignore file of the user who asks, read on the driver."""
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    try:
        with open(os.path.join(config, "git", "ignore"), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


@dataclass(frozen=True)
class Found:
    """A regular file under a root, or a warning about a folder."""

    relative: str
    stat: os.stat_result | None = None
    is_link: bool = False
    warning: str | None = None


def may_enter(folder: str, opts: Options) -> bool:
    """Whether the name of a folder (path under its root) lets a walk open it."""
    drop = _drops(opts)
    parts = folder.split("/")
    return (opts.hidden or not any(p.startswith(".") for p in parts)) and ".git" not in parts and not (drop and drop.match(folder + "/probe"))


def _drops(opts: Options) -> re.Pattern[str] | None:
    rx = paths.globs_regex((*paths.default_excludes(), *opts.exclude) if opts.default_excludes else opts.exclude)
    return re.compile(rx) if rx else None


def walk(root: str, opts: Options, only: str | None = None, user: str = "") -> Iterator[Found]:
    """Every regular file, in name order.  ``only``: '' for the files of the root itself, the name of
    a folder right below it for what that holds, all if not given."""
    if os.path.isfile(root):
        if not only:
            yield Found(os.path.basename(root), os.stat(root), os.path.islink(root))
        return
    drop = _drops(opts)

    def visit(folder: str, base: str, ignores: Ignores, above: tuple[tuple[int, int], ...]) -> Iterator[Found]:
        if opts.gitignore:
            ignores = ignores.enter(folder, base)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError as e:
            yield Found(base, warning=f"{folder}: {e.strerror or e}")
            return
        for e in entries:
            if base == "" and only and e.name != only:
                continue
            rel = base + escaped(e.name)
            link = e.is_symlink()
            if e.name == ".git" or (not opts.hidden and e.name.startswith(".")) or (link and not opts.follow_links):
                continue
            try:
                st = os.stat(e.path) if link else e.stat(follow_symlinks=False)
            except OSError as x:
                yield Found(rel, warning=f"{e.path}: {x.strerror or x}")
                continue
            is_dir = stat.S_ISDIR(st.st_mode)
            if opts.gitignore and ignores.drops(rel, is_dir):
                continue
            if is_dir:
                if (base == "" and only == "") or (drop and drop.match(rel + "/probe")):
                    continue
                key = (st.st_dev, st.st_ino)
                if link and key in above:
                    yield Found(rel, warning=f"{e.path}: a link to a folder above it")
                    continue
                yield from visit(e.path, rel + "/", ignores, (*above, key))
            elif stat.S_ISREG(st.st_mode) and not (base == "" and only) and not (drop and (drop.match(rel) or drop.match(rel.rsplit("/", 1)[-1]))):
                yield Found(rel, st, link)

    top = os.stat(root)
    yield from visit(root, "", Ignores.above(root, user) if opts.gitignore else Ignores(), ((top.st_dev, top.st_ino),))


class _Root(InputPartition):
    def __init__(self, index: int, path: str, label: str, several: bool, only: str | None) -> None:
        self.index, self.path, self.label, self.several, self.only = index, path, label, several, only


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], opts: Options, user: str = "") -> None:
        self.roots, self.opts, self.user = roots, opts, user

    def partitions(self) -> list[InputPartition]:
        names = labels(self.roots)
        out: list[InputPartition] = []
        for i, r in enumerate(self.roots):
            try:
                below = [e.name for e in os.scandir(r) if e.is_dir(follow_symlinks=self.opts.follow_links) and may_enter(escaped(e.name), self.opts)] if os.path.isdir(r) else []
            except OSError:
                below = []
            out += [_Root(i, r, names[i], len(self.roots) > 1, only) for only in ["", *sorted(below)]]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, _Root)
        single = os.path.isfile(partition.path)
        named = {os.path.realpath(r) for r in self.roots if os.path.isfile(r)}  # files that are roots themselves
        for f in walk(partition.path, self.opts, partition.only, self.user):
            if f.stat is None:
                yield (None, None, f.relative, None, partition.index, None, None, None, None, None, None, f.warning)
                continue
            shown = f"{partition.label}/{f.relative}" if partition.several else f.relative
            id_ = f"{partition.index}:{shown}" if partition.several else shown
            absolute = partition.path if single else os.path.join(partition.path, f.relative)
            st = f.stat
            yield (id_, shown, f.relative, absolute, partition.index, st.st_size, st.st_mtime_ns, f.is_link, st.st_dev, st.st_ino, single or (bool(named) and os.path.realpath(absolute) in named), None)


class FolioFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        o = dict(json.loads(self.options.get("options", "{}")))
        for k in ("include", "exclude", "roots"):
            if k in o:
                o[k] = tuple(o[k])
        return _Reader(json.loads(self.options["paths"]), Options(**o), self.options.get("ignore", ""))


def scan_all(spark: SparkSession, opts: Options) -> DataFrame:
    """Files of the roots of a request, and its warnings as rows of their own."""
    check_roots(list(opts.roots))
    spark.dataSource.register(FolioFiles)
    given = {"gitignore": opts.gitignore, "hidden": opts.hidden, "follow_links": opts.follow_links, "exclude": opts.exclude, "default_excludes": opts.default_excludes}
    return spark.read.format("folio_files").option("paths", json.dumps([os.path.abspath(r) for r in opts.roots])).option("options", json.dumps(given)).option("ignore", user_ignore() if opts.gitignore else "").load()


def scan(spark: SparkSession, opts: Options) -> DataFrame:
    """Files of the roots of a request."""
    return scan_all(spark, opts).where("warning IS NULL").drop("warning")


def warnings(rows: DataFrame, keep: int = 1_000) -> tuple[int, list[str]]:
    """How many warnings ``scan_all`` gave, and the first ``keep`` of them in path order."""
    said = rows.where("warning IS NOT NULL")
    return said.count(), [r[0] for r in said.orderBy("root_idx", "root_relative").select("warning").limit(keep).collect()]


def open_beneath(absolute: str, root: str) -> int:
    """Opens a regular file below a root component by component; links, devices and pipes that
    have taken its place are refused."""
    parts = os.path.relpath(absolute, root).split("/")
    folder = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for p in parts[:-1]:
            nxt = os.open(p, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=folder)
            os.close(folder)
            folder = nxt
        f = os.open(parts[-1], os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=folder)
    finally:
        os.close(folder)
    if not stat.S_ISREG(os.fstat(f).st_mode):
        os.close(f)
        raise OSError("no longer a regular file")
    return f


# Why a file is no longer the one the scan found.
GONE, LINKED, NOT_LINKED, NOT_REGULAR, NOT_FOLDER = "no longer there", "replaced by a symlink", "no longer a symlink", "no longer a regular file", "a folder on its path is no longer a folder"


def read_file(absolute: str, root_relative: str, is_symlink: bool, max_size: int) -> tuple[bytes | None, int | None, str | None]:
    """(bytes, size, why not) of a file as it is now; over the cap its size alone.

    The size is that of the open file, so one that has grown is reported with the size it has.
    """
    try:
        before = os.lstat(absolute)
        if stat.S_ISLNK(before.st_mode) != is_symlink:
            return None, None, NOT_LINKED if is_symlink else LINKED
        if not stat.S_ISREG((os.stat(absolute) if is_symlink else before).st_mode):
            return None, None, NOT_REGULAR
        root = absolute[: -len(root_relative)].rstrip("/") or "/"
        f = os.open(absolute, os.O_RDONLY | os.O_NONBLOCK) if is_symlink else open_beneath(absolute, root)
        with os.fdopen(f, "rb") as g:
            size = os.fstat(g.fileno()).st_size
            if size > max_size:
                return None, size, None
            body = g.read(max_size + 1)
            return (body, len(body), None) if len(body) <= max_size else (None, os.fstat(g.fileno()).st_size, None)
    except OSError as e:
        return None, None, {errno.ELOOP: LINKED, errno.ENOTDIR: NOT_FOLDER, errno.ENOENT: GONE}.get(e.errno or 0, e.strerror or NOT_REGULAR)


def with_bytes(files: DataFrame, max_size: int) -> DataFrame:
    """Adds bytes, read where the row is processed, once; null for a file over the cap, whose
    size is the true one, and for one that is no longer there, which ``gone`` explains."""

    columns = ["id", "relative", "root_relative", "bytes", "size", "modified_ns", "is_root", "gone"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: list[tuple] = []
            held = 0
            for row in pdf.itertuples(index=False):
                body, size, gone = read_file(row.absolute, row.root_relative, row.is_symlink, max_size)
                rows.append((row.id, row.relative, row.root_relative, body, row.size if size is None else size, row.modified_ns, row.is_root, gone))
                held += len(body or b"")
                if held > 16 << 20:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select("id", "relative", "root_relative", "absolute", "is_symlink", "size", "modified_ns", "is_root").mapInPandas(run, "id string, relative string, root_relative string, bytes binary, size bigint, modified_ns bigint, is_root boolean, gone string")


def head_bytes(files: DataFrame, limit: int = 8_192) -> DataFrame:
    """Adds head, the first bytes of the files whose name does not say their kind; null for all others."""
    named = files.withColumn("_named", classify.kind_from_name("relative").isNotNull())

    @F.pandas_udf("binary")
    def run(absolute: pd.Series, relative: pd.Series, link: pd.Series) -> pd.Series:
        def one(a: str, r: str, is_link: bool) -> bytes | None:
            try:
                f = os.open(a, os.O_RDONLY | os.O_NONBLOCK) if is_link else open_beneath(a, a[: -len(r)].rstrip("/") or "/")
                with os.fdopen(f, "rb") as g:
                    return g.read(limit)
            except OSError:
                return None

        return pd.Series([one(*x) for x in zip(absolute, relative, link)])

    unnamed = named.where("NOT _named").withColumn("head", run("absolute", "root_relative", "is_symlink"))
    return named.where("_named").withColumn("head", F.lit(None).cast("binary")).unionByName(unnamed).drop("_named")
