"""A small HTTP layer over the operators, for one person on one machine: scan, pack, map, preview,
redraw, download, progress and cancel as JSON.

Requests must name this host, come from no other origin and carry the session's secret; one pack
runs at a time, a second one is refused; manifests and results are kept within a number and a size.
"""

from __future__ import annotations

import hmac
import json
import secrets
import tempfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from folio import sample
from folio.functions.text import expand_home
from folio.operators import manifest, render, stats
from folio.operators.pack import admit, read_rows, scan_df
from folio.options import Options
from folio.plans.shared import materialized
from folio.results import Lru, Results, cancel, progress, tagged
from folio.sources.files import head_bytes, labels, scan_all, warnings, with_bytes

MAX_BODY, PREVIEW, SHOWN_WARNINGS = 8 << 20, 32_768, 3
_TAG = "folio-pack"


class Refused(Exception):
    def __init__(self, code: int, why: str) -> None:
        super().__init__(why)
        self.code = code


def same_secret(given: str | None, own: str) -> bool:
    """Compared in a time that does not depend on where they differ."""
    return hmac.compare_digest((given or "").encode(), own.encode())


def host_ok(host: str | None, port: int) -> bool:
    return (host or "").lower() in {f"{h}:{port}" for h in ("127.0.0.1", "localhost", "[::1]")}


def origin_ok(origin: str | None, host: str | None) -> bool:
    """No origin at all, or the page that this server would serve."""
    return origin is None or origin.lower() == f"http://{(host or '').lower()}"


def options(req: dict[str, Any]) -> Options:
    """A request's settings; unknown ones are refused."""
    known = {k: v for k, v in req.items() if k in Options.__dataclass_fields__}
    rest = set(req) - set(known) - {"selected", "result_id", "manifest_id"}
    if rest:
        raise Refused(400, f"unknown settings: {', '.join(sorted(rest))}")
    for k in ("roots", "include", "exclude"):
        if k in known:
            known[k] = tuple(known[k])
    roots = tuple(map(expand_home, known.pop("roots", (".",))))
    selected = req.get("selected")
    return Options(roots=roots, selection=None if selected is None else tuple(selected), **known)


class Session:
    """What the handlers share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, secret: str | None = None) -> None:
        self.spark, self.secret = spark, secret or secrets.token_urlsafe(24)
        self.folder = folder or tempfile.mkdtemp(prefix="folio-results-")
        self.results = Results(spark, self.folder)
        self.manifests: Lru[DataFrame] = Lru()
        self.busy, self.cancelled = threading.Lock(), threading.Event()

    def _files(self, opts: Options) -> tuple[DataFrame, int, int, list[str]]:
        try:
            walked = materialized(scan_all(self.spark, opts))
        except ValueError as e:
            raise Refused(400, str(e)) from e
        total, kept = warnings(walked)
        files, cut = admit(walked.where("warning IS NULL").drop("warning"), opts)
        return files, cut, total, kept

    def scan(self, req: dict[str, Any]) -> dict[str, Any]:
        opts = options(req)
        files, cut, total, kept = self._files(opts)
        rows = materialized(manifest.in_id_order(scan_df(head_bytes(files), opts)).select("id", "relative", "size", "kind", "language", "default_on", "oversized"))
        listed = [r.asDict() for r in rows.toLocalIterator()]
        key = secrets.token_hex(8)
        self.manifests.push(key, rows, sum(len(f["id"]) + 64 for f in listed))
        sums = manifest.manifest_bytes(rows).head()
        return {"manifest_id": key, "files": listed, "n_files": sums[0], "total_bytes": sums[1], "truncated": cut > 0, "warnings": stats.warning_lines(total, kept, SHOWN_WARNINGS)}

    def pack(self, req: dict[str, Any]) -> dict[str, Any]:
        opts = options(req)
        if not self.busy.acquire(blocking=False):
            raise Refused(409, "a pack is running")
        self.cancelled.clear()
        try:
            with tagged(self.spark, _TAG):
                files, cut, _, _ = self._files(opts)
                key = self.results.store(read_rows(with_bytes(files, opts.max_file_size), opts))
        except Exception as e:
            if self.cancelled.is_set():
                return {"error": "cancelled", "cancelled": True, "truncated": True}
            raise e
        finally:
            self.busy.release()
        packed = self.results.packed(key)
        assert packed is not None
        row = stats.finished(packed, cut).head().asDict()
        error = manifest.nothing_extracted(packed).head()[0]
        outcomes = [r.asDict() for r in manifest.outcomes(packed).orderBy("relative", "id").toLocalIterator()]
        label = "" if opts.tree == "none" else ", ".join(labels(list(opts.roots)))
        return row | self._drawn(key, opts.format, label) | {"result_id": key, "outcomes": outcomes, "error": error}

    def _drawn(self, key: str, fmt: str, label: str = "") -> dict[str, Any]:
        """The head of a dump and its whole length; the rest is counted, not held."""
        head, size = b"", 0
        try:
            for part in self.results.redraw(key, fmt, label):
                raw = part.encode()
                head += raw[: max(0, PREVIEW - len(head))]
                size += len(raw)
        except KeyError:
            raise Refused(404, "no such result") from None
        return {"dump": head.decode("utf-8", "ignore"), "dump_bytes": size, "preview_truncated": size > len(head), "format": fmt, "filename": f"folio.{_EXTENSION[fmt]}"}

    def render(self, req: dict[str, Any]) -> dict[str, Any]:
        return self._drawn(str(req.get("result_id")), _format(req.get("format", "plain")))

    def tree(self, req: dict[str, Any]) -> dict[str, Any]:
        opts = options(req)
        files, cut, _, _ = self._files(opts)
        return {"map": render.directory_map(files, ", ".join(labels(list(opts.roots))), opts.format), "truncated": cut > 0}

    def preview(self, req: dict[str, Any]) -> dict[str, Any]:
        selected = req.get("selected") or []
        if len(selected) != 1:
            raise Refused(400, "preview one file")
        opts = options(req)
        files, _, _, _ = self._files(opts)
        files = files.limit(1)  # the one that was asked for
        row = files.select("id").head()
        packed = materialized(read_rows(with_bytes(files, opts.max_file_size), opts))
        return manifest.preview(packed, row[0] if row else selected[0], PREVIEW).head().asDict()

    def cancel(self, _: dict[str, Any]) -> dict[str, Any]:
        self.cancelled.set()
        cancel(self.spark, _TAG)
        return {"cancelled": self.busy.locked()}

    def sample(self, req: dict[str, Any]) -> dict[str, Any]:
        return {"path": sample.materialize(str(req.get("parent") or self.folder))}


_EXTENSION = {"plain": "txt", "markdown": "md", "xml": "xml"}


def _format(name: object) -> str:
    got = {"txt": "plain", "md": "markdown"}.get(str(name), str(name))
    if got not in _EXTENSION:
        raise Refused(400, f"unknown format {name}; expected txt, md or xml")
    return got


def handler(session: Session) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: object) -> None:
            pass

        def _send(self, code: int, body: bytes, kind: str = "application/json", name: str | None = None) -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("X-Content-Type-Options", "nosniff")
            if name:
                self.send_header("Content-Disposition", f'attachment; filename="{name}"')
            self.end_headers()
            self.wfile.write(body)

        def _json(self, code: int, value: object) -> None:
            self._send(code, json.dumps(value, default=str).encode())

        def _admit(self) -> None:
            host = self.headers.get("Host")
            if not host_ok(host, self.server.server_address[1]) or not origin_ok(self.headers.get("Origin"), host):
                raise Refused(403, "wrong host or origin")
            if not same_secret(self.headers.get("X-Folio-Secret"), session.secret):
                raise Refused(401, "wrong secret")

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            try:
                if url.path == "/api/health":
                    self._json(200, {"ok": True})
                    return
                self._admit()
                if url.path == "/api/progress":
                    done, total = progress(session.spark)
                    self._json(200, {"done": done, "total": total, "busy": session.busy.locked()})
                elif url.path.startswith("/api/artifact/"):
                    key, fmt = url.path.rsplit("/", 1)[-1], _format(parse_qs(url.query).get("format", ["plain"])[0])
                    try:
                        parts = session.results.redraw(key, fmt)
                    except KeyError:
                        raise Refused(404, "no such result") from None
                    self.send_response(200)
                    self.send_header("Content-Type", "text/plain; charset=utf-8")
                    self.send_header("Content-Disposition", f'attachment; filename="folio.{_EXTENSION[fmt]}"')
                    self.send_header("Transfer-Encoding", "chunked")
                    self.end_headers()
                    for part in render.in_chunks(parts, 1 << 20):
                        raw = part.encode()
                        self.wfile.write(f"{len(raw):x}\r\n".encode() + raw + b"\r\n")
                    self.wfile.write(b"0\r\n\r\n")
                else:
                    raise Refused(404, "no such page")
            except Refused as e:
                self._json(e.code, {"error": str(e)})

        def do_POST(self) -> None:  # noqa: N802
            calls = {f"/api/{n}": getattr(session, n) for n in ("scan", "pack", "tree", "preview", "render", "cancel", "sample")}
            try:
                self._admit()
                size = int(self.headers.get("Content-Length") or 0)
                if size > MAX_BODY:
                    raise Refused(413, "the request is too large")
                body = self.rfile.read(size)
                if self.path not in calls:
                    raise Refused(404, "no such call")
                try:
                    req = json.loads(body or b"{}")
                except ValueError:
                    raise Refused(400, "the request is no JSON") from None
                if not isinstance(req, dict):
                    raise Refused(400, "the request is no object")
                self._json(200, calls[self.path](req))
            except Refused as e:
                self._json(e.code, {"error": str(e)})
            except Exception as e:  # noqa: BLE001 - a failed request must not end the server
                self._json(500, {"error": f"{type(e).__name__}: {str(e)[:500]}"})

    return Handler


def serve(spark: SparkSession, port: int = 0, folder: str | None = None, secret: str | None = None) -> tuple[ThreadingHTTPServer, Session]:
    """A server on this machine's own address, not yet running, and its session."""
    session = Session(spark, folder, secret)
    return ThreadingHTTPServer(("127.0.0.1", port), handler(session)), session
