"""A page to ask from: one session, its last turns, served by the driver."""

from __future__ import annotations

from collections import deque
from html import escape
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fathom.functions.text import escape_html
from fathom.streaming.session import Session

TURNS = 4
_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Fathom</title>
<style>body{{margin:2rem auto;max-width:45rem;background:#111;color:#ccc;font-family:sans-serif}}pre{{white-space:pre-wrap}}input{{width:75%}}a{{color:#999}}</style>
<h1>Fathom</h1><p>Stay calm; look for danger first; ask one thing at a time. <a href="/?clear=1">Forget</a></p>
<form method="post"><input name="q" value="{query}" autofocus> <button>Ask</button></form>
{turns}
</html>
"""
_EMPTY = "<p>Nothing asked yet.</p>"


def turn_html(query: str, answer: str) -> str:
    return f"<section><h2>{escape(query)}</h2><pre>{escape(answer)}</pre></section>"


def page(query: str, turns) -> bytes:
    """The page with the last TURNS of (query, answer)."""
    return _PAGE.format(query=escape(query), turns="\n".join(turn_html(*t) for t in list(turns)[-TURNS:]) or _EMPTY).encode()


def last_turns(turns: DataFrame, most: int = TURNS) -> DataFrame:
    """The last turns of each conversation, by (conv_id, turn), with all columns."""
    latest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("__fathom_n", F.row_number().over(latest)).filter(F.col("__fathom_n") <= most).drop("__fathom_n")


def history_html(turns: DataFrame, query: Column, answer: Column, most: int = TURNS) -> DataFrame:
    """(conv_id, html) of each conversation's last turns, for pages made in bulk."""
    shown = F.concat(F.lit("<section><h2>"), escape_html(query), F.lit("</h2><pre>"), escape_html(answer), F.lit("</pre></section>"))
    rows = last_turns(turns, most).select("conv_id", F.struct("turn", shown.alias("html")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["html"]), "\n").alias("html"))


def parameter(text: str, name: str) -> str:
    """The first value of a form's or query string's parameter, trimmed."""
    return parse_qs(text, keep_blank_values=True).get(name, [""])[0].strip()


def handler(session: Session) -> type[BaseHTTPRequestHandler]:
    turns: deque[tuple[str, str]] = deque(maxlen=TURNS)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            asked = urlsplit(self.path).query
            if parameter(asked, "clear") == "1":
                session.clear()
                turns.clear()
                self.reply("")
            else:
                self.reply(parameter(asked, "q"))

        def do_POST(self) -> None:
            self.reply(parameter(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8"), "q"))

        def reply(self, query: str) -> None:
            if query:
                turns.append((query, session.passage(query)))
            body = page(query, turns)
            self.send_response(200)
            for name, value in (("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))), ("Cache-Control", "no-store")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, format: str, *args: object) -> None:
            pass

    return Handler


def serve(engine, host: str = "127.0.0.1", port: int = 8765, server=HTTPServer) -> None:
    """Until interrupted; one session is shared by all who visit."""
    engine.stored()
    web = server((host, port), handler(Session(engine)))
    print(f"http://{host}:{port}")
    try:
        web.serve_forever()
    except KeyboardInterrupt:
        print()
    finally:
        web.server_close()
