import re
from collections import Counter, defaultdict

import pytest

from latentspark.llm import line_rules
from tests.llm.fixtures import documents, frame

WORD = r"[^\x20\x09-\x0D]+"


def brute_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def brute_removed(rows, min_docs, max_share, max_docs=100):
    def key(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line.lower())).strip(" ")

    hosts = defaultdict(set)
    for r in rows:
        hosts[r[3]].add(r[1] or "")
    counts = {h: Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k) for h, texts in hosts.items()}

    def bad(host, line):
        n = counts[host].get(key(line), 0)
        return n > min_docs and (n > max_docs or n > max_share * len(hosts[host]))

    return {(h, t): sum(len(key(x).split(" ")) for x in t.split("\n") if key(x) and bad(h, x)) for h, texts in hosts.items() for t in texts}


@pytest.mark.parametrize("share,most", [(0.1, 100), (0.9, 5), (2.0, 100_000)])
def test_matches_brute_force(spark, share, most):
    rows = documents()
    got = line_rules.line_rules(frame(spark, rows), 3, share, most).collect()
    removed = brute_removed(rows, 3, share, most)
    assert any(removed.values()) == (share < 1)
    expected = []
    for r in rows:
        base, gone = brute_base(r[1]), removed[r[3], r[1] or ""]
        left = base[0] - gone
        depleted = gone > 0 and (left < 0.3 * base[0] or left < 20)
        expected.append((str(r[0]), *base, gone, not base[5] and not depleted))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    assert sorted((str(r.doc_id), *(r[c] for c in columns)) for r in got) == sorted(expected)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_clean_rows_keep_and_cut(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_rules, "BROADCAST_REMOVALS", broadcast)
    rows = documents()
    docs = frame(spark, rows)
    kept = line_rules.clean_rows(docs, min_docs=3, max_share=0.1)
    assert kept.columns == docs.columns
    got = kept.collect()
    verdict = Counter(str(r.doc_id) for r in line_rules.line_rules(docs, min_docs=3, max_share=0.1).where("kept").collect())
    assert Counter(str(r.doc_id) for r in got) == verdict
    assert not any("repeats line" in r.text for r in got if r.source == "b")
    assert all(r.n_chars == len(r.text) for r in got)


def test_exact_copies_count_once(spark):
    text = "\n".join(" ".join(f"word{k}{j}{'x' * j}" for j in range(9)) for k in range(6))
    rows = [(i, text, "en", "a", 0) for i in range(200)]
    assert line_rules.line_rules(frame(spark, rows)).where("kept").count() == 200


def test_a_large_host_has_an_absolute_limit(spark):
    """A line in 101 of 3,000 texts goes, one in 100 stays; both are below the share."""
    rows = [(i, "\n".join([f"text number {'abcdefghij'[i % 10]} " + " ".join(f"w{'abcdefghij'[int(c)]}" * 3 for c in f"{i:05d}") * 6] + ["this line is everywhere"] * (i < 101) + ["this one is rarer"] * (i < 100)), "en", "a", 0) for i in range(3000)]
    got = {r.doc_id: r.removed_words for r in line_rules.line_rules(frame(spark, rows)).where("removed_words > 0").collect()}
    assert got == dict.fromkeys(range(101), 4)


def test_a_filter_does_not_repeat_the_features(spark):
    """The optimizer must leave a filter on the verdict above the projections that compute words and windows once."""
    plan = line_rules.base_features(frame(spark, documents())).where("NOT base_failed")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce") == 1


def test_empty_table(spark):
    empty = frame(spark, documents()).where("false")
    assert line_rules.line_rules(empty).count() == line_rules.clean_rows(empty).count() == 0
