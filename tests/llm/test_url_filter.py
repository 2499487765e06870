import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from ordertide.llm.queries import URL_RULES
from ordertide.llm.url_filter import DigestArray, array_bytes, filter_urls

PAGES = "page_id bigint, url string, host string, row string"
URLS = [
    "https://a.Example.ORG/es/x?y#z",
    "http://example.org/en/12",
    "http://example.org/en/2",
    "http://notexample.org/es/",
    "ftp://com/de/",
    "http://x.y.com/fr/",
    "http://x.com",
    "http://org",
    "http://org/",
    "no scheme.org/",
    "",
    None,
    "://x.org/ a",
    "http://a.com?/de/",
    "http://a.com#/de/",
    "http://é.com/de/é?",
    "http://a.b.c.d.e.f.example.org/es/" + "x" * 50_000,
    "http://" + "a." * 20_000 + "com/de/",
    "http://x.com/de/http://y.org/",
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for rule, verdict in rules:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), len(rule_host), rule, verdict))
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def run(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], PAGES)
    entries = spark.createDataFrame(rules, "entry string, verdict string")
    rows = filter_urls(pages, entries, **options).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


@pytest.mark.parametrize("max_bytes", [1 << 20, 20])
def test_one_array_and_shards_equal_brute_force(spark, max_bytes):
    rng = random.Random(1)
    rules = [*URL_RULES, ("a.com/", "block"), ("b.a.com/x", "allow"), ("b.a.com/xy/z", "block")]
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "q.org", "example.org", "m.example.org", "net"]
    urls = URLS + [f"http://{rng.choice(hosts)}/{rng.choice(['', 'x', 'xy/z', 'es/', 'en/1', 'de/'])}" for _ in range(60)]
    assert run(spark, urls, rules, max_bytes=max_bytes) == [brute(u, rules) for u in urls]


def test_empty_list_empty_table_and_bad_entries(spark):
    assert run(spark, ["http://a.com/"], [], default="block") == [("a.com", "/", None, "block")]
    assert run(spark, [], URL_RULES) == []
    assert run(spark, ["http://a.org/"] * 3, URL_RULES) == [("a.org", "/", "org/", "allow")] * 3
    both = [("org/", "allow"), ("org/", "block")]
    assert run(spark, ["http://a.org/"], both) == [("a.org", "/", "org/", "block")]
    for bad in ("org", None):
        with pytest.raises(ValueError, match="entry"):
            run(spark, ["http://a.org/"], [(bad, "block")])


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr("ordertide.llm.url_filter.xxhash.xxh64_intdigest", lambda raw: len(raw))
    names = ["1", "2", "3"]
    data = array_bytes(["aa", "bb", "c"], names, names)
    array = DigestArray(np.frombuffer(data, np.uint8), names)
    found = [array.value(at) if at >= 0 else None for at in array.probe(["bb", "aa", "cc", "c", "d"])]
    assert found == ["2", "1", None, "3", None]


def test_workers_of_an_executor_map_one_file(spark):
    """The list is shipped as a file, not with the tasks: no worker holds a copy of its own."""
    from pyspark import SparkFiles

    rules = [(f"h{i}.example.org/p{i}/", "block") for i in range(50_000)]
    assert run(spark, ["http://a.h7.example.org/p7/x", "http://h7.example.org/p8/"], rules) == [
        ("a.h7.example.org", "/p7/x", "h7.example.org/p7/", "block"),
        ("h7.example.org", "/p8/", None, "allow"),
    ]
    name = max(Path(SparkFiles.getRootDirectory()).glob("url-filter-array-*"), key=lambda p: p.stat().st_mtime).name

    def mapped(rows):
        from ordertide.llm.url_filter import _array_of

        for batch in rows:
            array = _array_of(name, ["block"])
            same = isinstance(array.digests.base, np.memmap) and not array.digests.flags.writeable
            yield pa.RecordBatch.from_pydict({"same": [same and len(array.digests) == 50_000] * batch.num_rows})

    found = spark.range(8, numPartitions=8).mapInArrow(mapped, "same boolean").collect()
    assert [r.same for r in found] == [True] * 8
