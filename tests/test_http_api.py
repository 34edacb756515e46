"""Every route, over a socket and on its faults."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from entwine import config
from entwine.http_api import Api, server
from entwine.service import Linker

VECTOR = [0.5] * 16


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    c = config.Config()
    c.store.path, c.embedding.embedding_dim, c.clustering.enabled = f"file://{tmp_path_factory.mktemp('http')}/store", 16, True
    return Api(Linker(spark, c))


def test_routes(api):
    call = lambda method, path, body=None: api.handle(method, path, json.dumps(body).encode() if body is not None else b"")
    assert call("GET", "/health")[1]["status"] == "ok"
    assert call("POST", "/entities", {"id": "a", "name": "Acme Corp", "zip": "10001", "vector": VECTOR}) == (201, {"id": "a"})
    code, got = call("POST", "/entities/batch", {"entities": [{"id": "b", "name": "Acme", "vector": VECTOR}, {"name": "No Id", "vector": VECTOR}]})
    assert code == 201 and got["count"] == 2 and got["ids"][0] == "b" and len(got["ids"][1]) == 64
    assert call("GET", "/entities/count") == (200, {"count": 3})
    assert call("GET", "/entities/a")[1]["name"] == "Acme Corp" and call("GET", "/entities/none")[0] == 404
    assert call("PUT", "/entities/a", {"name": "Acme Inc", "phone": "1"}) == (200, {"status": "updated", "id": "a"})
    got = call("GET", "/entities/a")[1]
    assert (got["name"], got["phone"], got["zip"], len(got["vector"])) == ("Acme Inc", "1", "10001", 16)
    assert [r["id"] for r in call("GET", "/entities?limit=2")[1]["entities"]][-1] in ("a", "b") and len(call("GET", "/entities?offset=2")[1]["entities"]) == 1
    assert call("DELETE", "/entities/a") == (200, {"status": "deleted", "id": "a"}) and call("GET", "/entities/count")[1] == {"count": 2}
    for bad in ({"vector": [1.0]}, {"name": "x"}):
        assert call("POST", "/entities", bad)[0] == 400 and call("POST", "/entities/batch", {"entities": [bad]})[0] == 400
    assert call("PUT", "/entities/b", {"vector": [1.0]})[0] == 400 and call("POST", "/entities/batch", {})[0] == 400
    assert call("POST", "/match", {})[0] == call("POST", "/match/text", {"text": ""})[0] == call("POST", "/match", [1])[0] == 400
    assert api.handle("POST", "/match", b"{")[0] == 400 and call("GET", "/nowhere")[0] == 404 and call("PATCH", "/match")[0] == 405
    assert call("GET", "/entities/b/group?strategy=odd")[0] == call("GET", "/entities/b/group?max_size=x")[0] == 400
    assert call("GET", "/entities/none/group")[0] == 404


def test_matching_over_a_socket(spark, api):
    fields = "id string, name string, address string, zip string"
    api.linker.add_entities(spark.createDataFrame([("m1", "Globex Corporation", "1 Main St", "02108"), ("m2", "Globex Corp.", "1 Main Street", "02108")], fields))
    http = server(api.linker, "127.0.0.1", 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", json.dumps(body).encode() if body else None, method=method)
        try:
            with urllib.request.urlopen(request, timeout=300) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    code, got = call("POST", "/match", {"entity": {"name": "Globex", "address": "1 Main St", "zip": "02108"}, "threshold": 0.2, "use_clustering": True, "include_scores": True, "field_weights": {"name": 1.0}})
    assert code == 200 and {m["id"] for m in got["matches"]} == {"m1", "m2"} and got["count"] == 2
    assert got["matches"][0]["field_scores"]["zip"]["score"] == 1.0 and got["matches"][0]["fields"]["zip"] == "02108"
    code, got = call("POST", "/match/text", {"text": "name=Globex;zip=02108", "threshold": 0.01, "limit": 1})
    assert code == 200 and got["count"] == 1
    code, got = call("POST", "/entities/m1/group", {"threshold_override": 0.2, "strategy": "direct"})
    assert code == 200 and got["size"] == 2 and got["primary_id"] == "m1"
    assert call("GET", "/entities/m1/group?threshold=0.2&strategy=transitive&hops_limit=1")[1]["size"] == 2
    assert call("GET", "/x")[0] == 404
    http.shutdown()
    assert api.handle("POST", "/clusters/recompute")[0] == 202
    api.background.join()
    assert api.linker.count() >= 2
