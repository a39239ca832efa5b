import re

from gridloom.llm import substring


def test_passages_inside_lines(spark):
    passage = "One two three four. Five six seven eight nine ten eleven twelve. Thirteen fourteen. Fifteen sixteen seventeen."
    docs = [
        (3, f"Some opening that nobody else has written down here. {passage} And an end of its own with several words."),
        (1, f"First of all, a line of its own.\n{passage}\nLast line."),
        (2, f"é. {passage.upper()}"),
        (4, "short line\nshort line"),
        (5, None),
        (6, ""),
        (7, "On ea. " * 40),
        (None, f"intro\n{passage}"),
    ]
    out = {r.doc_id: r for r in substring.dedup(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), 8, True).collect()}
    texts = dict(docs)
    assert out[1].text == texts[1] and not out[1].removed
    assert out[3].text == "Some opening that nobody else has written down here. And an end of its own with several words."
    assert out[2].text.strip() == "é."
    assert out[4].text == texts[4] and out[5].text is None and out[6].text == ""
    assert len(out[7].text) < 80
    assert "Five" not in out[None].text
    for k, r in out.items():
        left, last = [], 0
        for x in r.removed:
            left.append(texts[k][last : x.start])
            last = x.end
        assert r.text is None or "".join(left) + texts[k][last:] == r.text


def brute(docs, least):
    """doc_id -> word places that go: of lines and of windows that an earlier document or an earlier place has."""
    norm = lambda s: tuple(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in s)) if w)
    owner, lost = {}, {}
    parsed = {}
    for d, t in sorted(docs):
        at, parts = 0, []
        for line in (t or "").split("\n"):
            parts.append((at, at + len(norm(line))))
            at = parts[-1][1]
        words = norm(t or "")
        spans = [(a, b) for a, b in parts if b - a >= least]
        for k, (a, b) in enumerate(parts):  # runs from and up to a short line that has words
            if 0 < b - a < least:
                onto = next((e for _, e in parts[k:] if e - a >= least), None)
                back = next((s for s, e in parts[k::-1] if e > s and b - s >= least), None)
                spans += ([(a, onto)] if onto else []) + ([(back, b)] if back is not None else [])
        spans += [(0, len(words))] if len(words) >= substring.LONG else []
        spans += [(a, a + substring.LONG) for a in range(len(words) - substring.LONG + 1)]
        parsed[d] = (words, sorted(set(spans)))
        for a, b in spans:
            owner.setdefault(words[a:b], d)
    for d, (words, spans) in parsed.items():
        own, gone = {}, set()
        for a, b in spans:
            key = words[a:b]
            if owner[key] != d:
                gone.update(range(a, b))
            elif key in own:
                gone.update(range(max(a, own[key]), b))
            own.setdefault(key, b)
        lost[d] = gone
    return lost


def removed_places(text, removed):
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    return {i for i, (a, b) in enumerate(places) if any(x.start <= a and b <= x.end for x in removed)}


def test_against_brute_force(spark, documents):
    """What goes is what brute force says, word by word, and all else is still there."""
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    texts, want = dict(docs), brute(docs, substring.LEAST)
    assert sum(map(bool, want.values())) > 5
    for r in substring.dedup(spark, documents).collect():
        assert removed_places(texts[r.doc_id], r.removed) == want[r.doc_id], r.doc_id


def test_nothing_long_repeats(spark, documents):
    """After the pass no line of eight words or more is in two documents, if units are that short, and first ones are still there."""
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    out = {r.doc_id: r.text for r in substring.dedup(spark, documents, 8, True).collect()}
    seen, first = {}, {}
    norm = lambda s: tuple(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", s.lower()) if w)
    for d, t in sorted(docs):
        for line in t.split("\n"):
            if len(norm(line)) >= 8:
                first.setdefault(norm(line), d)
    for d, t in sorted(out.items()):
        for line in t.split("\n"):
            k = norm(line)
            if len(k) >= 8:
                assert k not in seen, (d, seen.get(k), line)
                seen[k] = d
    assert len(out) == len(docs)


def test_unnamed_documents_are_apart(spark):
    line = "a line that is long enough to be a unit of its own as it has more than twenty words in it and a few more"
    docs = [(None, f"{line}\nfirst"), (None, f"{line}\nsecond"), (None, f"{line}\nsecond"), (3, "nothing else"), ((1 << 61), f"{line}\nthird")]
    out = substring.dedup(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(r.text for r in out) == sorted([f"{line}\nthird", "first", "nothing else", "second", "second"])


def test_awkward(spark, awkward):
    assert substring.dedup(spark, awkward).count() == awkward.count()
    assert substring.dedup(spark, awkward.limit(0)).count() == 0


def test_passage_without_sentence_ends(spark):
    """A passage of over 50 words goes whole, though it starts and ends inside sentences and has none of its own."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = words("p", 60)
    docs = [
        (1, f"{words('a', 30)} {passage} {words('b', 30)}."),
        (2, f"{words('c', 12)} {passage.upper()} {words('d', 12)}."),
        (3, f"{words('e', 9)}\n{passage[: passage.index(' p55')].replace(' p30', chr(10) + 'p30')}, {words('f', 9)}"),
        (4, f"{words('g', 20)} {passage[: passage.index(' p49')]} {words('h', 20)}"),
        (5, f"{words('i', 20)} {words('q', 70)} {words('j', 20)} {words('q', 70)} {words('k', 20)}"),
        (6, " ".join(["again"] * 130)),
        (7, f"{words('l', 60)} {passage[: passage.index(' p55')]}"),
        (None, passage[passage.index("p8") :]),
    ]
    out = {r.doc_id: r for r in substring.dedup(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert out[1].text == docs[0][1] and out[4].text == docs[3][1]
    assert out[2].text == f"{words('c', 12)} {words('d', 12)}."
    assert out[3].text.split() == f"{words('e', 9)} {words('f', 9)}".split()
    assert out[5].text == f"{words('i', 20)} {words('q', 70)} {words('j', 20)} {words('k', 20)}"
    assert out[6].text.split() == ["again"] * 50
    assert out[7].text == f"{words('l', 60)} " and out[None].text == ""


def test_no_shared_window_is_missed(spark, documents):
    """Against brute force: of an earlier document's windows of 50 words, every word is removed from a later one."""
    norm = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", s.lower()) if w]
    docs = {r.doc_id: norm(r.text or "") for r in documents.collect()}
    out = {r.doc_id: r for r in substring.dedup(spark, documents).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    at = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    seen: set = set()
    for d in sorted(docs):
        places = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[d] or ""))
        assert len(places) == len(docs[d])
        gone = {i for i, m in enumerate(places) if any(x.start <= m.start() and m.end() <= x.end for x in out[d].removed)}
        covered, k = set(), substring.LONG
        for i, w in enumerate(at(docs[d], k)):
            if w in seen:
                covered.update(range(i, i + k))
        assert covered <= gone, d
        seen.update(at(docs[d], k))


def test_blocks_of_short_lines(spark):
    """A block of lines under LEAST words goes as a whole from later documents; a single short line stays."""
    verse = "Up the hill\nand down\nwe go at dawn\nby night\nwe are home"
    docs = [
        (1, f"Some words before.\n{verse}\nAnd some behind."),
        (2, f"Another start\n{verse}\nanother end"),
        (3, f"A heading\n{verse.upper()}"),
        (4, "and down\n\nby night"),
        (5, "one two\nthree four\n" * 30),
        (6, f"{verse}\nA line of its own that has more than eight words in it."),
    ]
    out = {r.doc_id: r for r in substring.dedup(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), 8, True).collect()}
    assert out[1].text == docs[0][1] and out[4].text == docs[3][1]
    assert out[2].text == "Another start\nanother end"
    assert out[3].text.strip() == "A heading"
    assert out[5].text.split() == "one two three four one two three four".split()
    assert out[6].text == "A line of its own that has more than eight words in it."
