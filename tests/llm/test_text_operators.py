import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from factsift.llm import html_rules, pii_feistel, toxicity, warc_index
from factsift.llm import queries as registered

from .conftest import TEXTS


# ---- toxicity ---------------------------------------------------------------------
def read(text, insults=("idiot",)):
    return toxicity.read_clause([(m.group(), 2.0 if m.group() in insults else 0.0) for m in toxicity.TOKEN.finditer(text.lower())])


def test_grammar_reads_clauses():
    assert read("you are an idiot") == {"aimed": 2.0}
    assert read("an idiot like you")["aimed"] == 2.0
    assert read("an idiot") == {"plain": 2.0}
    assert read("you are not an idiot")["denied"] == 2.0
    assert read('she said that he is an idiot')["quoted"] == 2.0
    assert read('the word "idiot" is rude')["quoted"] == 2.0
    assert read("i will kill you")["threats"] == 1.0
    assert not read("kill will you")["threats"]


def test_learned_scores_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    tp = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert tp >= 0.8 * sum(r.toxic for r in got) and tp >= 0.9 * sum(r.predicted for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


@pytest.mark.parametrize("d", ["sf0.1", "check_s"])
def test_the_grammar_decides_on_the_learned_model(spark, d):
    d = f"/root/testdata/{d}"
    model = toxicity.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    weights = dict(zip(toxicity.FEATURES, model.weights))
    assert weights["denied"] <= 0 and weights["quoted"] <= 0 and all(weights[f] >= 0 for f in toxicity.RAISES)
    high = ["You are an idiot, a moron and a worthless loser.", "I will kill you.", "We are going to hurt you tomorrow."]
    low = ["You are not an idiot, not a moron, never a worthless loser.", 'She said "you are an idiot, a moron and a worthless loser."',
           "He called them stupid.", "The weather is fine.", "I will not be there.", ""]
    scores = toxicity._scores(high + low, model)
    assert all(scores[:len(high)] >= toxicity.THRESHOLD) and all(scores[len(high):] < toxicity.THRESHOLD), (scores, weights)


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == len(TEXTS) and not any(r.held_out for r in rows if r.doc_id is None) and not any(r.predicted for r in rows)
    kept = toxicity.reject(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == len(TEXTS)
    rude = spark.createDataFrame([(1, "You are an idiot, a worthless moron and a pathetic loser. " * 3)], "doc_id long, text string")
    assert toxicity.reject(rude, model).count() == 0 and toxicity.reject(nothing, model).count() == 0


# ---- personal data ----------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.integers(2, 10**18), st.data())
def test_feistel_is_a_permutation(n, data):
    x = data.draw(st.integers(0, n - 1))
    y = pii_feistel.permute(x, n, "t")
    assert 0 <= y < n and pii_feistel.permute(y, n, "t", reverse=True) == x


def test_feistel_covers_a_small_range():
    assert sorted(pii_feistel.permute(x, 1000, "t") for x in range(1000)) == list(range(1000))


@pytest.mark.parametrize("kind,value", [
    ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("account", "9807915762804490"), ("ssn", "123-45-6789"),
    ("phone", "+1 (017) 555-7713"), ("phone", "555-123-4567"), ("ip", "192.168.0.1"), ("date", "2024-02-29"), ("date", "12/31/1999"),
    ("date", "01.02.2003"), ("email", "jane.DOE+x9@mail3.example.com"), ("email", "a@b.org"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ("secret", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce')])
def test_pseudonyms_keep_format_and_are_undone(kind, value):
    text = f"see {value}\" and {value}, or so"
    new, spans = pii_feistel.replace(text)
    assert [s[0] for s in spans] == [kind, kind] and value not in new
    a, b = (new[s[3]:s[4]] for s in spans)
    assert a == b and len(a) == len(value) or kind == "ip"
    assert pii_feistel.replace(new, reverse=True)[0] == text
    if kind == "card":
        assert pii_feistel.luhn("".join(filter(str.isdigit, a))) == 0
    if kind == "iban":
        assert pii_feistel.iban_rest(a.replace(" ", "")) == 1


@pytest.mark.parametrize("text", ["version 1.2.3.4.5", "999.1.1.1", "2024-13-01", "000-12-3456", "1234", "a @ b", "no data here", "",
                                  "Licensed under CC BY-NC 4.0."])
def test_what_is_not_valid_stays(text):
    assert pii_feistel.replace(text) == (text, [])


@pytest.mark.parametrize("kind,value,text", [
    ("card", "4111 1111 1111 1111", "pay {} 12/27"), ("card", "4111111111111111", "{} 123"), ("card", "4111 1111 1111 1111", "row 12 {}"),
    ("card", "3782 822463 10005", "7 {} 99"), ("account", "9807 9157 6280 4490", "no 5 {} 1"),
    ("iban", "ES91 2100 0418 4502 0005 1332", "to {} IS"), ("iban", "ES91 2100 0418 4502 0005 1332", "AB12 {} ISBN 12"),
    ("date", "31/12/1999", "on {}."), ("date", "12.31.1999", "on {}"), ("phone", "+49 30 901820", "call {}, or"),
    ("phone", "+33 1 23 45 67 89", "call {}"), ("phone", "+49 (30) 9018 2011", "call {}"), ("email", "_jane.roe@mail.example.com", "at {}"),
    ("email", "-jane.roe@example.com", "at {}"), ("email", "łucja@example.com", "at {}")])
def test_values_beside_other_groups_are_found(kind, value, text):
    text = text.format(value)
    new, spans = pii_feistel.replace(text)
    assert [(s[0], text[s[1]:s[2]]) for s in spans] == [(kind, value)] and value not in new
    assert pii_feistel.replace(new, reverse=True)[0] == text


def test_values_beside_other_groups_are_undone():
    rng = np.random.default_rng(4)
    for _ in range(300):
        body = "".join(map(str, rng.integers(0, 10, 15)))
        card = body + str(-pii_feistel.luhn(body + "0") % 10)
        text = f"{rng.integers(1, 99)} {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} {rng.integers(1, 99)}"
        new, spans = pii_feistel.replace(text)
        assert card[:8] not in new.replace(" ", "") and pii_feistel.undo(new, spans) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9999).map("{:04d}".format), st.integers(0, 10**6).map(str)), max_size=6),
       st.integers(0, 10**15 - 1).map("{:015d}".format), st.lists(st.integers(0, 9999).map("{:04d}".format), max_size=6), st.sampled_from(" -"))
def test_a_card_in_a_run_of_groups_is_linked_and_undone(before, body, after, sep):
    card = body + str(-pii_feistel.luhn(body + "0") % 10)
    card = sep.join(card[i:i + 4] for i in range(0, 16, 4))
    text = f"x {sep.join([*before, card, *after])} y"
    new, spans = pii_feistel.replace(text)
    assert pii_feistel.undo(new, spans) == text
    at = text.index(card)
    place = next((s for s in spans if s[1] == at and s[2] == at + 19), None)
    if place:                                   # the same pseudonym as alone
        assert new[place[3]:place[4]] == pii_feistel.pseudonym("card", card)
    else:                                       # only a valid number that overlaps it may come first
        assert any(s[1] < at + 19 and at < s[2] and s[0] == "card" for s in spans)


def test_numbers_beside_others():
    card = "5260 1815 9083 0164"
    alone = pii_feistel.pseudonym("card", card)
    for text in ("x 9628 {} y", "{} 9628 1234 77", "2024 {}", "on 7 2024-01-02 {}", "9628 {} 123-45-6789"):
        new, spans = pii_feistel.replace(text.format(card))
        assert alone in new and card not in new and ("card", alone) in [(s[0], new[s[3]:s[4]]) for s in spans]
    assert [s[0] for s in pii_feistel.replace(f"on 7 2024-01-02 {card}")[1]] == ["date", "card"]
    iso, slashes = pii_feistel.replace("1980-03-05 and 1980/03/05")[0].split(" and ")
    assert iso.replace("-", "/") == slashes != "1980/03/05"
    long = " ".join(["9628", card] * 20_000)
    new, spans = pii_feistel.replace(long)
    assert pii_feistel.undo(new, spans) == long and card not in new


def test_reported_places_undo_the_table(spark):
    rows = [(1, "9628 5260 1815 9083 0164, call +49 30 901820"), (2, None), (None, ""), (3, "1980/03/05 a@b.org"), (3, "1980/03/05 a@b.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reported = pii_feistel.report(docs)
    assert sorted(map(str, pii_feistel.restore(reported).collect())) == sorted(map(str, docs.collect()))
    assert reported.where("n_found > 0").count() == 3


def test_pseudonymise_keeps_rows_and_columns(spark, awkward, nothing):
    out = pii_feistel.pseudonymise(awkward)
    assert out.schema == awkward.schema and sorted(map(str, out.collect())) == sorted(map(str, awkward.collect()))
    assert pii_feistel.report(awkward).where("n_found > 0").count() == 0 and pii_feistel.pseudonymise(nothing).count() == 0


# ---- HTML ---------------------------------------------------------------------------
PROSE = "It is not the end of the road but the start of a way that you and I can go on with for as long as we like."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href=/a>{PROSE}</a></ul></nav><div class="ad-slot">{PROSE}</div><article><header><h1>Head &amp; line</h1></header>
<p>{PROSE}<br>and&nbsp;more</p><p>Short.<script>var t="</p>";</script><form>f</form><p>a &lt; b<div id="comments"><p>{PROSE}</p></div>
<aside>{PROSE}</aside></article><div role=complementary>{PROSE}</div><footer>&copy; {PROSE}</footer></body></html>"""
    assert html_rules.main_text(page) == f"Head & line\n\n{PROSE} and more\n\nShort.\n\na < b"


@pytest.mark.parametrize("paragraphs", [
    ["\u4eca\u5929\u7684\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u3002" * 3] * 2,
    ["Prezydent poleci jutro do Warszawy, gdzie spotka sie z ministrami dziewieciu panstw regionu."] * 2,
    ["Rain fell.", "Nobody came."]])
def test_rules_without_an_article_or_stop_words(paragraphs):
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(9))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f'<body><ul>{menu}</ul><div>{body}</div><ul>{menu}</ul><div class="footer"><p>{paragraphs[0]}</p></div></body>'
    assert html_rules.main_text(page) == "\n\n".join(paragraphs)
    assert html_rules.main_text(f'<body><ul>{menu}</ul><div class="footer"><p>{paragraphs[0]}</p></div></body>') == ""


def test_rules_without_an_article():
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(9))
    page = f"<body><ul>{menu}</ul><div>{PROSE}</div><div>near</div><div>{PROSE}</div><ul>{menu}</ul><div>far</div></body>"
    assert html_rules.main_text(page) == f"{PROSE}\n\nnear\n\n{PROSE}"


@pytest.mark.parametrize("name", ["elementor-widget elementor-widget-text-editor", "related-story", "notice", "post-header", "social"])
def test_names_within_an_article_are_evidence_only(name):
    page = f"""<body><div class="sidebar widget">{PROSE}</div><article><header class="entry-header"><h1>Head</h1></header>
<div class="{name}"><p>{PROSE}</p><p>Short.</p></div><div class="social share">Tell others</div><div class="social">Follow us</div>
<div id="comments"><p>{PROSE} {PROSE} {PROSE}</p></div></article></body>"""
    assert html_rules.main_text(page) == f"Head\n\n{PROSE}\n\nShort."


def test_a_name_around_all_text_counts_nothing():
    page = f"<body><div class='page has-sidebar'><div class=widget><p>{PROSE}</p></div><div class=comments><p>{PROSE} x</p></div></div></body>"
    assert html_rules.main_text(page) == PROSE


@pytest.mark.parametrize("name", ["notice", "banner", "widget", "related", "social", "disclaimer", "discussion"])
def test_notices_and_discussions_of_an_article_go(name):
    page = f"<body><article><h1>Head</h1><p>{PROSE}</p><div class='{name}'><p>{PROSE} Notice.</p><p>Short.</p></div><p>{PROSE}</p></article></body>"
    assert html_rules.main_text(page) == f"Head\n\n{PROSE}\n\n{PROSE}"
    # an article that is all made of such elements is text
    page = "<body><article>" + f"<div class='{name}'><p>{PROSE}</p></div>" * 4 + "</article></body>"
    assert html_rules.main_text(page).count(PROSE) == 4


def test_nested_names_take_linear_time():
    import time
    for name in ("comments", "widget", "comments widget"):
        page = f"<div class='{name}'>{PROSE}" * 2000 + "</div>" * 2000
        begin = time.monotonic()
        assert PROSE in html_rules.main_text(page)
        assert time.monotonic() - begin < 3
    page = "<div class=comments>x" * 2000 + f"<div class=reply>{PROSE}"
    begin = time.monotonic()
    assert PROSE in html_rules.main_text(page) and time.monotonic() - begin < 1


def test_story_beside_teaser_articles():
    cards = "".join(f"<article><p>{PROSE} {i}</p></article>" for i in range(2))
    page = f"<body><div>{(f'<p>{PROSE}</p>') * 5}</div>{cards}</body>"
    assert html_rules.main_text(page).count(PROSE) == 7
    page = f"<body><div><p>{PROSE}</p></div><article>{(f'<p>{PROSE}</p>') * 5}</article></body>"
    assert html_rules.main_text(page).count(PROSE) == 5


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<!--", "<script>", "</p></p>", "<a b='", "&#xD800;&", "<b>" * 5000 + "x"])
def test_broken_pages(html):
    assert isinstance(html_rules.main_text(html), str)


def test_extract_matches_the_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_rules.extract(pages.unionByName(pages.limit(0))).collect()}
    import html as h
    import re
    for p in pages.collect():
        body = p.html[p.html.index("<article>") + 9:p.html.index("</article>")]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", body)]
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x) and got[p.page_id].n_chars == len(got[p.page_id].text)
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text long")
    assert [(r.page_id, r.text, r.n_chars) for r in html_rules.extract(rows).orderBy("page_id").collect()] == [(None, "", 0), (1, "", 0), (1, "", 0)]


# ---- WARC -----------------------------------------------------------------------------
def test_record_round_trip():
    payload = "<p>ü\r\n\r\nx</p>".encode()
    warc, http, got = warc_index.parse_record(warc_index.build_record("7", "http://a/ü", payload, warc_index.digest(payload), None))
    assert got == payload and warc["Page-ID"] == "7" and int(http["Content-Length"]) == len(payload)
    warc, http, got = warc_index.parse_record(warc_index.build_record("8", None, payload, "X", "7"))
    assert got == b"" and warc["Refers-To-Page-ID"] == "7" and warc["WARC-Type"] == "revisit" and int(http["Content-Length"]) == len(payload)


def test_url_keys_sort_by_reversed_host():
    key = warc_index.url_key
    assert key("https://www.Example.com:443/a?b=1#c", "5") == "com,example)/a?b=1 5"
    assert key("http://x.org:8080", "1") == "org,x:8080)/ 1" and key(None, "-") == " -" and key("http://[", "1")


def test_archives_are_read_back_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<p>{i % 13}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "http://a.com", "<p>1</p>"), (102, "http://a.com/x", "alone"), (102, "http://a.com/x", "alone")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key long, sha string")
    got = sorted(warc_index.read_captures(pages, warc_index.archive(pages)[1]).collect(), key=lambda r: str(r.page_id))
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        p = html[r.page_id].encode()
        refers = first[html[r.page_id]] if first[html[r.page_id]] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (
            len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers)
    empty = pages.limit(0)
    assert warc_index.read_captures(empty, warc_index.archive(empty)[1]).count() == 0


# ---- registry and pipeline ----------------------------------------------------------------
def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark, tmp_path):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose), (2, prose + " more"), (3, "You are an idiot, a worthless moron, a pathetic loser. " * 4), (4, "write to jane.roe@mail.example.com now"),
            (5, "ask about " + " ".join(f"bench{i}" for i in range(15))), (6, None), (7, ""), (None, "nobody"), (8, "x y"), (8, "x y")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, sid long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"BENCH{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "sid"]
        kept[name] = sorted(str(r.doc_id) for r in docs.collect())
    assert kept["toxicity"] == sorted(str(i) for i, _ in rows if i != 3)
    assert kept["near_duplicates"] == sorted(["1", "4", "5", "6", "7", "None", "8"])
    assert kept["decontamination"] == kept["personal_data"] == sorted(["1", "4", "6", "7", "None", "8"])
    text = docs.where("doc_id = 4").first().text
    assert "jane" not in text and text.endswith(".example.com now") and len(text) == 38
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in out.collect()) == kept["personal_data"]
    assert len({r.sequence_id for r in out.collect()}) == 1 and np.isclose(sum(r.length for r in out.collect()), max(r.offset + r.length for r in out.collect()))


def test_pipeline_drops_copies_of_080_to_085(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:55] + [f"other{i}" for i in range(5)])),      # 51 of 61 shingles
            (3, " ".join(words[:53] + [f"third{i}" for i in range(7)]))]                            # 49 of 63
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
