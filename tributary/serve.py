"""A small HTTP service over the engine: ``POST /api/v1/transform`` (multipart) and ``GET /health``."""

from __future__ import annotations

import json
import logging
import tempfile
from email import policy
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from tributary.operators.project import pretty
from tributary.plans.engine import VERSION, fuse_files

log = logging.getLogger("tributary")

# Names of the form's fields, and the source and file name of each.
FIELDS = {"csv_file": ("csv", "recruiter.csv"), "ats_file": ("ats", "ats.json"), "resume_file": ("resume", "resume.pdf"), "github_url": ("github", ""), "notes_file": ("notes", "notes.txt"), "config_file": ("config", "output_config.json")}


def form(content_type: str, body: bytes) -> dict[str, tuple[bytes, str | None]]:
    """Content and file name of each field of a multipart body."""
    message = BytesParser(policy=policy.HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    out = {}
    for part in message.iter_parts() if message.is_multipart() else ():
        name = part.get_param("name", header="content-disposition")
        if name:
            out[name] = (part.get_payload(decode=True) or b"", part.get_filename())
    return out


def transform(spark: SparkSession, fields: dict[str, tuple[bytes, str | None]]) -> tuple[int, bytes]:
    """Status and body of the answer. Files are written where driver and executors read them: uploads are one entity's, so the driver's folder serves a local session, and a cluster names a shared one in spark.checkpoint.dir."""
    given = {FIELDS[n]: v for n, v in fields.items() if n in FIELDS and v[0]}
    if not any(source != "config" for source, _ in given):
        return 400, problem("At least one input source is required: " + ", ".join(n for n in FIELDS if n != "config_file"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    top = shared.removeprefix("file://") if shared.startswith(("file://", "/")) else None
    if top:
        Path(top).mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=top) as folder:
        inputs: dict[str, object] = {}
        for (source, file), (data, name) in given.items():
            if source == "github":
                inputs[source] = data.decode().strip()
                continue
            suffix = Path(name).suffix if source == "resume" and name else Path(file).suffix
            path = Path(folder) / (Path(file).stem + suffix)
            path.write_bytes(data)
            inputs[source] = str(path)
        try:
            config = inputs.pop("config", None)
            fused = fuse_files(spark, inputs, config)
            return 200, pretty(fused.json.first()["json"])
        except ValueError as e:
            return 400, problem(str(e))
        except Exception as e:  # the service goes on whatever one request meets
            log.exception("transform")
            return 500, problem(f"Pipeline error: {str(e).splitlines()[0]}")


def problem(text: str) -> bytes:
    return json.dumps({"detail": text}, indent=2).encode()


def handler(spark: SparkSession) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = self.path == "/health"
            self.answer(200 if found else 404, json.dumps({"status": "healthy", "version": VERSION}).encode() if found else problem("Not Found"))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path != "/api/v1/transform":
                self.answer(404, problem("Not Found"))
            else:
                self.answer(*transform(spark, form(self.headers.get("Content-Type", ""), body)))

        def answer(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, text: str, *args: object) -> None:
            log.info(text, *args)

    return Handler


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(spark))
