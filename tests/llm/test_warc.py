import gzip
import random

from trustmill.llm import warc


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN_ROWS", 10)
    rng = random.Random(2)
    rows = []
    for i in range(200):
        url = rng.choice(["http://A.com/x", "https://www.a.com/x/", "a", "http://b.org/?b=1&a=2&utm_source=q#f", "http://b.org:80?a=2&b=1", None])
        status, ts = rng.choice([200, 304, 304, 404, None]), rng.choice([None, *range(40)])
        headers = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("Last-Modified", rng.choice(["d1", "d2", None])), ("Content-Length", str(i)), ("Age", str(i % 3))) if v}
        rows.append((i, url, ts, status, rng.choice([headers, headers, None]), f"body{i}" if status == 200 else None, 1))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, digest string, source_id int")
    canon = {"http://A.com/x": "a.com/x", "https://www.a.com/x/": "a.com/x", "a": "", "http://b.org/?b=1&a=2&utm_source=q#f": "b.org?a=2&b=1", "http://b.org:80?a=2&b=1": "b.org?a=2&b=1", None: None}
    want = {}
    for i, url, ts, status, headers, digest, _ in rows:
        h = {k.lower(): v for k, v in (headers or {}).items()}
        best = None
        if ts is not None and url is not None:
            best = max(((r[2], r[0], r) for r in rows if r[3] == 200 and r[2] is not None and r[1] is not None and canon[r[1]] == canon[url] and r[2] < ts), default=None)
        outcome, source = "other", None
        if status == 200:
            outcome = "response"
        elif status == 304:
            outcome = "unmatched"
            if best:
                b = {k.lower(): v for k, v in (best[2][4] or {}).items()}
                bare = lambda e: e and e.removeprefix("W/")
                if "etag" not in h and "last-modified" not in h:
                    outcome = "unvalidated"
                elif bare(h["etag"]) == bare(b.get("etag")) if "etag" in h else h["last-modified"] == b.get("last-modified"):
                    outcome, source, digest = "resolved", best[1], best[2][5]
                    h = b | {k: v for k, v in h.items() if k not in warc.FIXED_HEADERS}
                else:
                    outcome = "changed"
        want[i] = (canon[url], outcome, source, sorted(h.items()), digest)
    got = {r.record_id: (r.canonical_url, r.outcome, r.source_id, [(x["name"], x["value"]) for x in r.headers], r.digest) for r in warc.resolve(df).collect()}
    assert got == want and {w[1] for w in want.values()} == {"response", "resolved", "changed", "unvalidated", "unmatched", "other"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_read_warc(spark, tmp_path):
    def record(kind, block, url="http://a.com/", date="2024-01-01T00:00:00Z"):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    first = record("response", b'HTTP/1.1 200 OK\r\nETag: "1"\r\n\r\nhello')
    then = record("revisit", b'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\n\r\n', date="2024-01-02T00:00:00Z")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(then))
    captures = warc.read_warc(spark, str(tmp_path / "x.warc.gz"))
    assert [bytes(r.body) for r in captures.orderBy("ts").collect()] == [b"hello", b""]
    assert {r.outcome for r in warc.resolve(captures).collect()} == {"response", "resolved"}
