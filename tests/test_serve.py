from __future__ import annotations

import http.client
import json
import threading

import pytest

from folio import sample
from folio.serve import host_ok, origin_ok, same_secret, serve


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    s, session = serve(spark, folder=str(tmp_path_factory.mktemp("results")))
    thread = threading.Thread(target=s.serve_forever, daemon=True)
    thread.start()
    yield s.server_address[1], session
    s.shutdown()


def call(server, method: str, path: str, body: dict | None = None, **headers: str) -> tuple[int, bytes]:
    port, session = server
    c = http.client.HTTPConnection("127.0.0.1", port, timeout=120)
    c.request(method, path, None if body is None else json.dumps(body), {"X-Folio-Secret": session.secret, **headers})
    r = c.getresponse()
    return r.status, r.read()


def post(server, name: str, body: dict) -> dict:
    status, raw = call(server, "POST", f"/api/{name}", body)
    assert status == 200, raw
    return json.loads(raw)


def test_who_may_ask(server):
    assert call(server, "GET", "/api/health")[0] == 200
    assert call(server, "GET", "/api/progress", **{"X-Folio-Secret": "x"})[0] == 401
    assert call(server, "GET", "/api/progress", Origin="http://elsewhere.example")[0] == 403
    assert call(server, "GET", "/api/progress", Host="elsewhere.example")[0] == 403
    assert call(server, "GET", "/none")[0] == 404 and call(server, "POST", "/api/none", {})[0] == 404
    assert same_secret("a", "a") and not same_secret(None, "a") and host_ok("LOCALHOST:1", 1) and not host_ok(None, 1) and origin_ok(None, None)


def test_scan_pack_redraw_and_download(server, tmp_path):
    root = sample.materialize(str(tmp_path))
    got = post(server, "scan", {"roots": [root]})
    assert got["n_files"] == 11 and {f["relative"] for f in got["files"]} >= {"src/main.py", "docs/plan.docx"} and not got["truncated"]
    packed = post(server, "pack", {"roots": [root], "selected": ["readme.md", "src/rows.py"], "format": "markdown"})
    assert packed["files_extracted"] == 2 and packed["error"] is None and "## readme.md" in packed["dump"] and packed["filename"] == "folio.md"
    assert post(server, "render", {"result_id": packed["result_id"], "format": "xml"})["dump"].startswith("<documents>")
    status, raw = call(server, "GET", f"/api/artifact/{packed['result_id']}?format=txt")
    assert status == 200 and b"FILE: src/rows.py" in raw
    assert call(server, "GET", "/api/artifact/none")[0] == 404 and call(server, "POST", "/api/render", {"result_id": "none"})[0] == 404
    assert "└── " in post(server, "tree", {"roots": [root]})["map"]
    assert post(server, "preview", {"roots": [root], "selected": ["docs/plan.docx"]})["text"] == "Planting plan\nTwo rows of quince."
    assert call(server, "POST", "/api/preview", {"roots": [root], "selected": []})[0] == 400
    assert call(server, "POST", "/api/scan", {"roots": [str(tmp_path / "none")]})[0] == 400
    assert call(server, "POST", "/api/scan", {"odd": 1})[0] == 400
    assert post(server, "pack", {"roots": [root], "selected": ["data/older.zip"]})["error"].startswith("Nothing extracted.")


def test_one_pack_at_a_time(server, tmp_path):
    session = server[1]
    session.busy.acquire()
    try:
        assert call(server, "POST", "/api/pack", {"roots": [str(tmp_path)]})[0] == 409
        assert post(server, "cancel", {}) == {"cancelled": True}
    finally:
        session.busy.release()
    assert json.loads(call(server, "GET", "/api/progress")[1])["busy"] is False
    assert post(server, "sample", {"parent": str(tmp_path)})["path"].endswith("orchard")
