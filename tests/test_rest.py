"""Offset pages of any size, counted ranges and a stream that goes on after a restart."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewright.sources import rest


class Server:
    """Serves rows 0 to n - 1. Pages are as long as asked for, unless `size` (offset, limit) says otherwise."""

    def __init__(self, n, size=lambda offset, limit: limit):
        self.n, self.size, self.asked = n, size, []
        own = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = parse_qs(urlparse(self.path).query)
                offset, limit = int(q["offset"][0]), int(q["limit"][0])
                own.asked.append((offset, limit))
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"rows": [{"k": k} for k in range(offset, min(own.n, offset + own.size(offset, limit)))]}).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/?offset={{offset}}&limit={{limit}}"


@pytest.fixture
def serve():
    made = []

    def start(*args):
        made.append(Server(*args))
        return made[-1]

    yield start
    for s in made:
        s.server.shutdown()


def rows(df):
    return sorted(r[0] for r in df.select(F.get_json_object("row", "$.k").cast("int")).collect())


def load(spark, url, **options):
    spark.dataSource.register(rest.RestSource)
    return spark.read.format("rest_pages").options(url=url, data_path="rows", **options).load()


def test_offsets_grow_by_rows_received(spark, serve):
    more = serve(103, lambda offset, limit: limit + offset % 7)  # pages longer than asked for
    assert rows(load(spark, more.url, limit=10)) == list(range(103))
    short = serve(60, lambda offset, limit: limit if offset < 20 else 4)
    assert rows(load(spark, short.url, limit=10)) == list(range(24))  # a short page is the last
    assert rows(load(spark, serve(20).url, limit=10, max_pages=2)) == list(range(20))
    with pytest.raises(Exception, match="max_pages"):
        load(spark, serve(21).url, limit=10, max_pages=2).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 101])
def test_counted_ranges(spark, serve, n):
    uneven = serve(n, lambda offset, limit: 1 + offset * 5 % 13)  # of any size, whatever is asked for
    df = load(spark, uneven.url, limit=10, rows_per_task=9)
    assert rows(df) == list(range(n)) and df.rdd.getNumPartitions() == max(1, -(-n // 9))
    uneven.asked.clear()
    assert rest.RestReader({"url": uneven.url, "data_path": "rows"}).count(uneven.url) == n
    assert len(uneven.asked) <= 2 * max(1, n).bit_length() + 2


def test_stream_goes_on(spark, serve, tmp_path):
    spark.dataSource.register(rest.RestSource)
    server, batches = serve(25, lambda offset, limit: 1 + offset % 4), []

    def run():
        stream = spark.readStream.format("rest_pages").options(url=server.url, data_path="rows", limit=5, rows_per_task=6).load()
        q = stream.writeStream.foreachBatch(lambda df, _: batches.append(rows(df))).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    server.n = 40
    run()
    run()
    assert [b for b in batches if b] == [list(range(25)), list(range(25, 40))]


def test_stream_needs_offsets(spark):
    with pytest.raises(ValueError):
        rest.RestStreamReader({"url": "http://x/"})
