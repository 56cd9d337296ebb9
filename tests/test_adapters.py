"""Adapters that the command line builds: environment files, mail server, model endpoint, probing; and numbering of sparse order."""

import http.server
import json
import threading
from dataclasses import dataclass

from tidemark import cli
from tidemark.config import Config, env_file
from tidemark.operators import ordering
from tidemark.sources import fetch, models, sinks


def test_environment_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# mail\nexport TIDEMARK_SMTP_HOST='mail.example'\nTIDEMARK_BULLETS=3\nTIDEMARK_MAX_CHARS=7\nbroken\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("TIDEMARK_BULLETS", "4")
    config = Config.from_env()
    assert (config.smtp_host, config.bullets, config.max_chars) == ("mail.example", 4, 7) and env_file("none") == {}


def test_server_and_model_only_where_configured():
    assert sinks.smtp_from(Config()) is None and models.from_config(Config()) is None
    assert sinks.smtp_from(Config(smtp_host="mail.example", smtp_port=25)) == sinks.Smtp("mail.example", 25)


class _Chat(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = asked["messages"][0]["content"]
        if "fail" in text:
            self.send_error(500)
            return
        body = json.dumps({"choices": [{"message": {"content": f"{asked['model']} {self.headers['Authorization']} {text[-5:]}"}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_chat_model_answers_and_failures_cost_one_text(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = models.from_config(Config(model_url=f"http://127.0.0.1:{server.server_port}/", model_name="m", model_key="k"), models.summary_prompt)
        df = spark.createDataFrame([(1, "first"), (2, "fail"), (3, "third"), (4, "")], "id bigint, text string")
        got = {r["id"]: r["answer"] for r in models.answered(df, "id", "text", model, 2).collect()}
    finally:
        server.shutdown()
    assert got == {1: "m Bearer k first", 2: None, 3: "m Bearer k third"}


def test_probe_asks_for_the_head_first(spark):
    @dataclass(frozen=True)
    class _Probe:
        def open(self):
            return None

        def head(self, session, url):
            if url.endswith("refuses"):
                raise OSError
            return (405, url, None) if url.endswith("get-only") else (200, url, "application/pdf" if url.endswith("pdf") else "text/html")

        def get(self, session, url):
            if url.endswith("pdf"):
                return 200, url, "application/pdf", b""
            return (404, url, "text/html", b"") if url.endswith("refuses") else (200, url + "/landed", "text/html", b"")

    df = spark.createDataFrame([(k, f"https://e.com/{x}") for k, x in enumerate(("page", "get-only", "pdf", "refuses"))], "ord bigint, url string")
    assert {(r["ord"], r["url"]) for r in fetch.reachable(df, _Probe()).collect()} == {(0, "https://e.com/page"), (1, "https://e.com/get-only/landed")}


def test_numbering_of_sparse_order(spark):
    rows = [(hash((k, "x")) % (1 << 62),) for k in range(3000)]
    df = spark.createDataFrame(rows, "ord bigint").repartition(7)
    got = [r["n"] for r in ordering.numbered(df).orderBy("ord").collect()]
    assert got == list(range(3000)) and ordering.numbered(df.limit(0)).count() == 0


def test_a_failed_cycle_is_reported(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--pages", str(tmp_path / "missing.parquet"), "--once", "--log-file", str(tmp_path / "log")]) == 1
    assert "the cycle failed" in (tmp_path / "log").read_text()
