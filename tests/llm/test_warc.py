import hashlib
import random
from collections import Counter

import pytest

from tablewise.llm import warc


def pages_rows():
    rnd = random.Random(3)
    rows = [(i, f"http://h{i}.com/é\r\nx", "<p>" + "".join(rnd.choice("abcé\r\n ") for _ in range(rnd.randint(0, 3000))) + "WARC/1.1\r\n\r\n", 9, "x") for i in range(40)]
    rows += [(100 + i, "u", "same " * 40, 1, "y") for i in range(30)] + [(-5, None, "same " * 40, 1, "y")]
    rows += [(200, "u", None, 1, "y"), (201, "u", "", 1, "y"), (202, "u", "", 1, "y"), (203, "u", "short", 1, "y"), (204, "u", "short", 1, "y"), (None, "u", "same " * 40, 1, "y"),
             (300, "u", "x" * 300_000, 1, "y"), (301, "u", "".join(map(str, range(60000))), 1, "y"), (40, "u", "twice " * 30, 1, "y"), (40, "u", "twice " * 30, 1, "y")]
    return rows


SCHEMA = "page_id long, url string, html string, payload_bytes int, record_type string"


def brute(rows):
    first = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = Counter()
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        again = b in first and first[b] != i
        out[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None] += 1
    return out


def test_round_trip(spark, tmp_path):
    rows = pages_rows()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = warc.archive_and_read(pages, str(tmp_path / "a"))
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert warc.archive_and_read(pages.limit(0), str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("split", [700, 4096, 1 << 20])
def test_ranges_and_pushdown(spark, tmp_path, split):
    rows = pages_rows()
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    whole = lambda: warc.read(spark, path, split)
    assert Counter(r.page_id for r in whole().select("page_id").collect()) == Counter(r[0] for r in rows)
    texts = {r.page_id: bytes(r.payload) for r in whole().where("record_type = 'response'").collect()}
    assert all(texts[i] == (html or "").encode() for i, _, html, *_ in rows if i in texts)
    some = whole().where("record_type = 'revisit' and page_id in (101, 102, 3)").select("page_id", "payload_bytes")
    assert sorted(map(tuple, some.collect())) == [(101, 200), (102, 200)]
    assert whole().where("payload_bytes > 200000 and record_type = 'response'").count() == 2
