"""The service over HTTP: JSON in and out, one route for each operation of a Linker. python -m entwine.http_api [config]"""

from __future__ import annotations

import json
import re
import sys
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .functions.normalize import FIELDS
from .operators.groups import GroupOptions
from .operators.matching import MatchOptions
from .schema import RECORD
from .service import Linker
from .sources.store import Conflict

Answer = tuple[int, object]
STRATEGIES = ("direct", "transitive", "hybrid")
#: Largest body that is read.
MOST_BYTES = 64 << 20


class BadRequest(ValueError):
    pass


def _rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded frame as JSON objects, without nulls."""
    return [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j")).collect()]


def _number(kind: type, values: dict, name: str):
    """A parameter as a number, None where it is missing or zero."""
    try:
        return kind(values[name]) or None if values.get(name) not in (None, "") else None
    except (TypeError, ValueError):
        raise BadRequest(f"invalid {name}") from None


class Api:
    """Answers requests: handle(method, path with query, body)."""

    def __init__(self, linker: Linker):
        self.linker, self.spark = linker, linker.spark
        self.background: threading.Thread | None = None
        self.routes: list[tuple[str, re.Pattern, Callable[[str, dict], Answer]]] = [
            (method, re.compile(path), fn)
            for method, path, fn in (
                ("GET", "/health", self.health),
                ("POST", "/entities", self.add),
                ("POST", "/entities/batch", self.add_batch),
                ("GET", "/entities/count", self.count),
                ("GET", "/entities", self.page),
                ("GET", "/entities/([^/]+)/group", self.group),
                ("POST", "/entities/([^/]+)/group", self.group),
                ("GET", "/entities/([^/]+)", self.get),
                ("PUT", "/entities/([^/]+)", self.put),
                ("DELETE", "/entities/([^/]+)", self.delete),
                ("POST", "/match", self.match),
                ("POST", "/match/text", self.match_text),
                ("POST", "/clusters/recompute", self.recompute),
            )
        ]

    def handle(self, method: str, target: str, body: bytes = b"") -> Answer:
        url = urlsplit(target)
        found = [(m, p, fn) for m, pattern, fn in self.routes if (p := pattern.fullmatch(url.path.rstrip("/") or "/"))]
        if not found:
            return 404, {"error": "no such path"}
        match = next(((p, fn) for m, p, fn in found if m == method), None)
        if not match:
            return 405, {"error": "method not allowed"}
        try:
            values = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if body:
                given = json.loads(body)
                if not isinstance(given, dict):
                    raise BadRequest("a JSON object is expected")
                values |= given
            return match[1](unquote(match[0][1]) if match[0].groups() else "", values)
        except (BadRequest, json.JSONDecodeError, UnicodeDecodeError) as e:
            return 400, {"error": str(e)}
        except Conflict as e:
            return 409, {"error": str(e)}
        except Exception as e:
            return 500, {"error": str(e)[:500]}

    # Entities
    def _records(self, items: list) -> DataFrame:
        """Records as they are, with vectors of the right dimension."""
        known = [f.name for f in RECORD]
        for k, item in enumerate(items):
            if not isinstance(item, dict):
                raise BadRequest(f"entity {k} is no object")
            if len(item.get("vector") or ()) != self.linker.dim:
                raise BadRequest(f"entity {k} needs a vector of dimension {self.linker.dim}")
        text = [(json.dumps({n: item[n] for n in known if n in item}),) for item in items]
        parsed = self.spark.createDataFrame(text, "j string").select(F.from_json("j", RECORD).alias("r")).select("r.*")
        return self.linker.store._shaped(parsed)

    def health(self, _id: str, _values: dict) -> Answer:
        return 200, {"status": "ok", "store_healthy": self.linker.health(), "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}

    def add(self, _id: str, values: dict) -> Answer:
        rows = self._records([values])
        self.linker.add_entities(rows, raw=True)
        return 201, {"id": rows.first()["id"]}

    def add_batch(self, _id: str, values: dict) -> Answer:
        items = values.get("entities")
        if not items or not isinstance(items, list):
            raise BadRequest("no entities provided")
        rows = self._records(items)
        self.linker.add_entities(rows, raw=True)
        ids = [r["id"] for r in rows.select("id").collect()]
        return 201, {"status": "added", "count": len(ids), "ids": ids}

    def get(self, id_: str, _values: dict) -> Answer:
        found = _rows(self.linker.get_entity(id_).limit(1))
        return (200, found[0]) if found else (404, {"error": f"no entity {id_}"})

    def put(self, id_: str, values: dict) -> Answer:
        given = {f.name: values[f.name] for f in RECORD if f.name in values and f.name != "id"}
        if given.get("vector") is not None and len(given["vector"]) not in (0, self.linker.dim):
            raise BadRequest(f"a vector of dimension {self.linker.dim} is expected")
        if not given.get("vector", True):
            given.pop("vector")
        row = self.spark.createDataFrame([(json.dumps(given | {"id": id_}),)], "j string").select(F.from_json("j", RECORD).alias("r"))
        self.linker.update_entities(row.select("r.id", *[f"r.{n}" for n in given]))
        return 200, {"status": "updated", "id": id_}

    def delete(self, id_: str, _values: dict) -> Answer:
        self.linker.delete_entities(self.spark.createDataFrame([(id_,)], "id string"))
        return 200, {"status": "deleted", "id": id_}

    def count(self, _id: str, _values: dict) -> Answer:
        return 200, {"count": self.linker.count()}

    def page(self, _id: str, values: dict) -> Answer:
        """One page in the order of the ids; 100 rows by default, 1,000 at most."""
        limit = min(1000, _number(int, values, "limit") or 100)
        return 200, {"entities": _rows(self.linker.list_entities(_number(int, values, "offset") or 0, limit).drop("vector"))}

    # Matching
    def _options(self, values: dict) -> MatchOptions:
        m = self.linker.config.matching
        return MatchOptions(
            limit=_number(int, values, "limit") or m.default_limit,
            threshold=_number(float, values, "threshold") or m.similarity_threshold,
            use_clustering=bool(values.get("use_clustering")),
            include_field_scores=bool(values.get("include_scores")),
            field_weights=values.get("field_weights") or {},
            field_types=values.get("field_type_mappings") or {},
        )

    def _matches(self, df: DataFrame) -> Answer:
        out = []
        for r in sorted(_rows(df), key=lambda r: r["rank"]):
            scores = {f: {"score": r[f"score_{f}"]} for f in FIELDS if f"score_{f}" in r}
            one = {"id": r["id"], "score": r["score"], "fields": {f: r.get(f, "") for f in FIELDS}, "matched_on": r.get("matched_on", []), "explanation": r["explanation"]}
            out.append(one | ({"field_scores": scores} if scores else {}))
        return 200, {"matches": out, "count": len(out)}

    def match(self, _id: str, values: dict) -> Answer:
        entity = values.get("entity")
        if not isinstance(entity, dict):
            raise BadRequest("an entity is required")
        if entity.get("vector") and len(entity["vector"]) != self.linker.dim:
            raise BadRequest(f"a vector of dimension {self.linker.dim} is expected")
        row = self.spark.createDataFrame([tuple(str(entity.get(f) or "") for f in ("id", *FIELDS))], ", ".join(f"{f} string" for f in ("id", *FIELDS)))
        return self._matches(self.linker.match_entities(row, self._options(values)))

    def match_text(self, _id: str, values: dict) -> Answer:
        if not values.get("text"):
            raise BadRequest("a text is required")
        return self._matches(self.linker.match_text(str(values["text"]), self._options(values)))

    def group(self, id_: str, values: dict) -> Answer:
        strategy = values.get("strategy") or "hybrid"
        if strategy not in STRATEGIES:
            raise BadRequest(f"the strategy must be one of {', '.join(STRATEGIES)}")
        threshold = _number(float, values, "threshold_override") or _number(float, values, "threshold") or self.linker.config.matching.similarity_threshold
        options = GroupOptions(threshold, _number(int, values, "max_size") or 100, strategy, _number(int, values, "hops_limit") or 3)
        found = self.linker.group_json(self.linker.get_entity(id_).select("id"), options).collect()
        return (200, json.loads(found[0]["json"])) if found else (404, {"error": f"no entity {id_}"})

    def recompute(self, _id: str, _values: dict) -> Answer:
        """Answers at once; the blocks are written in the background."""
        if not self.linker.config.clustering.enabled:
            raise BadRequest("clustering is not enabled")
        self.background = threading.Thread(target=self.linker.recompute_clusters, daemon=True)
        self.background.start()
        return 202, {"status": "processing"}


def server(linker: Linker, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""
    api, c = Api(linker), linker.config.api

    class Handler(BaseHTTPRequestHandler):
        timeout = c.read_timeout_secs

        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            code, payload = (413, {"error": "too large"}) if size > MOST_BYTES else api.handle(self.command, self.path, self.rfile.read(size) if size else b"")
            raw = json.dumps(payload).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *_args) -> None:
            pass

    return ThreadingHTTPServer((host if host is not None else c.host, c.port if port is None else port), Handler)


def main() -> None:
    spark = SparkSession.builder.appName("entwine").getOrCreate()
    linker = Linker(spark, settings.load(sys.argv[1] if len(sys.argv) > 1 else "config.yaml"), embedder=None)
    linker.store.create()
    server(linker).serve_forever()


if __name__ == "__main__":
    main()
