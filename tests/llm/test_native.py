import datetime as dt
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, ODD
from wayfare.llm import quality, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed,
    )


def test_base_figures_match_brute_force(documents):
    pick = random.Random(3)
    texts = [" ".join(pick.choice("abc") for _ in range(pick.randint(0, 40))) for _ in range(60)]
    texts += ["\n".join(pick.choice(["x y", "x  y", "", " ", "# |z"]) for _ in range(8)) for _ in range(20)]
    texts += ["same " * 300, "a b c d e f g a b c d e", *ODD]
    rows = quality.quality_rules(documents(texts, **CLASHING)).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base_figures(texts[r.doc_id]), texts[r.doc_id]
    assert len(rows) == len(texts)


def test_lines_that_a_host_repeats_across_documents_are_removed(documents):
    letters = "abcdefghij"
    own = [" ".join(f"{letters[i // 10]}{letters[i % 10]}{letters[k]}" for k in range(10)) for i in range(60)]
    banner = "Accept ALL cookies 2024 now please dear reader of ours"
    texts = [t + ("\n" + banner.replace("2024", str(1000 + i)) if i % 2 == 0 and i < 40 else "") for i, t in enumerate(own)]
    texts[50] = banner + "\n" + banner  # nothing else left
    rows = {r.doc_id: r for r in quality.quality_rules(documents(texts)).collect()}
    assert rows[0].n_removed_words == 10 and rows[0].kept
    assert rows[50].n_removed_words == 20
    assert rows[50].kept is False
    assert rows[1].n_removed_words == 0 and rows[1].kept


def test_copies_of_one_document_do_not_make_boilerplate(documents):
    text = "\n".join(" ".join(f"{x}{y}" for y in "klmno") for x in "abcde")
    rows = quality.quality_rules(documents([text] * 30)).collect()
    assert all(r.kept and r.n_removed_words == 0 for r in rows) and len(rows) == 30


def test_frequent_lines_are_cut_from_texts(documents):
    own = [f"own {'abcdefghijklmnopqrst'[i]} a b c" for i in range(20)]
    texts = [f"{t}\nshared line here" for t in own]
    docs = documents(texts)
    lines = quality.frequent_lines(quality.document_digests(docs), 0.05, 5)
    cut = {r.doc_id: r.text for r in quality.without_frequent_lines(docs, lines).collect()}
    assert cut == dict(enumerate(own))
    assert quality.quality_rules(documents([])).collect() == []


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def brute_listed(edits, pattern, when):
    state, since = False, None
    for moment in sorted({a for p, a, _ in edits if p == pattern and a is not None and a <= when}):
        listed = any(x for p, a, x in edits if p == pattern and a == moment)
        state, since = listed, moment
    return state, since


def test_url_filters_match_brute_force(spark):
    pick = random.Random(11)
    hosts = ["a.b.example.com", "www.c.example.org", "d.example.net", "example.com"]
    patterns = hosts + ["*.b.example.com", "d.example.net/x", "*.d.example.net", "*.example.com", "*.example.org"]
    moments = [at(d, h, m) + dt.timedelta(microseconds=u) for d in (1, 2, 5, 9) for h in (0, 13) for m in (0, 59) for u in (0, 100_000, 900_000)]
    edits = [(pick.choice(patterns), pick.choice(moments), pick.random() < 0.6) for _ in range(150)]
    edits += [(None, at(1), True), ("d.example.net", None, True)]
    captures = [(i, f"https://{pick.choice(['', '', 'user:p@w@'])}{pick.choice(hosts)}/{pick.choice('xy')}/p?q@r", pick.choice(moments) + dt.timedelta(microseconds=pick.choice([-1, 0, 1, 10**6]))) for i in range(300)]
    captures += [(900, None, at(3)), (901, "not a url", at(3)), (902, "https://d.example.net/x", None), (1, captures[1][1], captures[1][2])]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumns(
        {c: F.lit("clash") for c in ("pattern", "__host", "__at", "at", "of_day", "a.b")}
    )
    listing = spark.createDataFrame(edits, "pattern string, at timestamp, listed boolean")
    rows = url_filters.filter_captures(frame, listing).collect()
    assert len(rows) == len(captures)
    for r in rows:
        want = (False, None, None)
        match = re.match(r"https://([^/]+)/?([^/?]*)", r.url or "")
        if match and r.fetched_at is not None:
            host, segment = match.groups()
            host = host.rpartition("@")[2]
            labels = host.split(".")
            sites = ["*." + ".".join(labels[-n:]) for n in (3, 2) if len(labels) >= n]
            for pattern in ([f"{host}/{segment}"] if segment else []) + [host, *sites]:
                state, since = brute_listed(edits, pattern, r.fetched_at)
                if state:
                    want = (True, pattern, since)
                    break
        assert (r.listed, r.pattern, r.since) == want, r


def test_two_edits_within_a_second(spark):
    edits = [("e.example.com", at(1) + dt.timedelta(milliseconds=100), True), ("e.example.com", at(1) + dt.timedelta(milliseconds=900), False)]
    listing = spark.createDataFrame(edits, "pattern string, at timestamp, listed boolean")
    times = [(0, at(1)), (1, at(1) + dt.timedelta(milliseconds=500)), (2, at(2))]
    captures = spark.createDataFrame([(i, "https://e.example.com/", t) for i, t in times], "page_id long, url string, fetched_at timestamp")
    assert {r.page_id: r.listed for r in url_filters.filter_captures(captures, listing).collect()} == {0: False, 1: True, 2: False}


def test_url_filters_with_empty_sides(spark):
    captures = spark.createDataFrame([(1, "https://x.y.example.com/a", at(1))], "page_id long, url string, fetched_at timestamp")
    none = spark.createDataFrame([], "pattern string, at timestamp, listed boolean")
    assert [r.listed for r in url_filters.filter_captures(captures, none).collect()] == [False]
    assert url_filters.filter_captures(captures.limit(0), none).collect() == []
