"""Registered queries of the operators in this folder, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careloom.llm import conversations, decontaminate, embeddings, licenses, neardup, packing, quality, spelling, substrings, tokens, toxicity, urls, warc
from careloom.plans.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[Tables], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    return fn


@query
def op1_warc(t: Tables) -> DataFrame:
    """Every page as a WARC record, read back through the index."""
    folder = warc.archive_folder(t.spark)
    index = warc.write_archives(warc.with_revisits(t.pages), folder)
    read = warc.read_records(index, folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


SQL["op1_warc"] = """
with p as (select page_id, url, coalesce(html, '') body, sha1(coalesce(html, '')) sha from pages),
r as (select *, max(page_id) over (partition by sha) chosen, upper(sha) hex from p),
bits as (select page_id, url, body, chosen, list_transform(range(8), lambda g:
        ('0x' || substr(hex, g * 5 + 1, 5))::int) five from r)
select page_id, strlen(body)::bigint payload_bytes,
    array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') payload_digest,
    case when page_id = chosen then 'response' else 'revisit' end record_type,
    case when page_id <> chosen then chosen end refers_to, url, true intact
from bits"""


@query
def op3_token_counts(t: Tables) -> DataFrame:
    """Tokens of every whole document."""
    counted = tokens.count_tokens(t.documents.select("doc_id", "text"), tokens.tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


RULES = [
    urls.Rule("org/", "allow"),
    urls.Rule("example.org/es/", "block"),
    urls.Rule("example.org/en/1", "block"),
    urls.Rule("com/fr/", "allow"),
    urls.Rule("com/de/", "block"),
]


@query
def op7_url_filter(t: Tables) -> DataFrame:
    """Every page's URL judged by the rules, and by the model where none fits."""
    judged = urls.judge_urls(t.pages.select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@query
def op10_best_fit_packing(t: Tables) -> DataFrame:
    """Every document's pieces packed into sequences of 2048 tokens."""
    return packing.pack_documents(t.documents, tokens.tokenizer_path("word_bpe_49k.json"), 2048)


@query
def op2_decontaminate(t: Tables) -> DataFrame:
    """Words of every document inside benchmark windows."""
    found = decontaminate.find_items(t.documents, t.benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_toxicity(t: Tables) -> DataFrame:
    """Toxicity of every document by a model of the labels that are not held out."""
    labels = t.labels.filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(t.documents, labels)
    scored = toxicity.score_toxicity(t.documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.col("predicted").cast("int").alias("predicted"))


@query
def op9_quality(t: Tables) -> DataFrame:
    """Quality of every document by heuristics whose accuracy is learned without labels."""
    model = quality.fit_quality(t.documents)
    scored = quality.score_quality(t.documents.select("doc_id", "text"), model)
    return scored.select("doc_id", "quality_score", "keep")


@query
def op4_minhash_near_dedup(t: Tables) -> DataFrame:
    """Components of documents of which 85 of 100 shingles agree."""
    found = neardup.near_duplicates(t.documents, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op6_embedding_near_dedup(t: Tables) -> DataFrame:
    """Components of vectors with a cosine of 0.95 or more."""
    found = embeddings.near_duplicates(t.embeddings, cosine=0.95)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@query
def op5_substring_dedup(t: Tables) -> DataFrame:
    """Passages of 50 words and more that a smaller document holds as well."""
    found = substrings.repeated_spans(t.documents)
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("kept_doc_id"), F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"))


@query
def op11_spelling_variants(t: Tables) -> DataFrame:
    """Words of all documents with their near words, most frequent form and root."""
    return spelling.spelling_variants(t.documents)


@query
def op12_license_scan(t: Tables) -> DataFrame:
    """License phrases and labels of every document."""
    found = licenses.scan_licenses(t.documents.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op13_prefix_trie(t: Tables) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt around those that share first turns."""
    return conversations.prefix_trie(t.conversations, every=20)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED_WORDS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

SQL["op2_decontaminate"] = f"""
with d as (select row_number() over () r, doc_id, {_ALNUM_WORDS} w from documents),
i as (select item_id, w, least(10, len(w)) n from (select item_id, {_ALNUM_WORDS} w from benchmark) where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') win from (
    select *, unnest(range(1, len(w) - n + 2)) k from i)),
dw as (select r, k, n, array_to_string(w[k:k + n - 1], ' ') win from (
    select r, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from iw))),
hit as (select r, k, n, item_id from dw join iw using (n, win)),
place as (select r, count(distinct p) n_hit from (select r, unnest(range(k, k + n)) p from hit) group by r),
named as (select r, count(distinct item_id) n_items,
    sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) ids from hit group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
    coalesce(ids, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join place using (r) left join named using (r)"""

SQL["op4_minhash_near_dedup"] = f"""
with recursive d as (select doc_id, {_SPACED_WORDS} w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[k:k + 4], ' ') end x
    from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) k from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
link as (select a, b from (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2)
    join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a doc_id, min(b) m from reach group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id,
    doc_id = least(doc_id, coalesce(m, doc_id)) kept
from d left join n using (doc_id) left join least using (doc_id)"""

SQL["op6_embedding_near_dedup"] = """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
ok as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(e, lambda x: abs(x))) > 0),
link as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a vec_id, min(b) m from reach group by 1),
n as (select a vec_id, count(*) n from link group by 1)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(m, vec_id)) component_id,
    vec_id = least(vec_id, coalesce(m, vec_id)) kept
from v left join n using (vec_id) left join least using (vec_id)"""


def _crc32(text: str) -> str:
    """SQL for the checksum of a text of ASCII and Latin-1 letters, byte by byte."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    code = f"list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)"
    both = f"flatten(list_transform({code}, lambda x: case when x < 128 then [x] else [192 + (x >> 6), 128 + (x & 63)] end))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {both}), lambda c, b: {step}), 4294967295)"


SQL["op11_spelling_variants"] = rf"""
with recursive r as (select coalesce(doc_id::varchar, '') || ':' id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) n
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) run from documents) group by all),
h as (select run, n, {_crc32('id || run')} h from r),
c as (select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, sum(n)::bigint n from h group by 1),
w as (select word, n from c where n >= 2 and length(word) >= 7),
cut as (select word, n, i, left(word, i) || substr(word, i + 2) rest from (select *, unnest(range(0, length(word)))::int i from w)),
near as (select a.word, a.n, b.word other, b.n other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, a.n, b.word, b.n from cut a join w b on a.rest = b.word
    union select b.word, b.n, a.word, a.n from cut a join w b on a.rest = b.word),
best as (select word, count(*) n_near, arg_min(other, (-other_n, other)) form, max(other_n) form_n from near group by 1),
f as (select w.word, w.n, coalesce(n_near, 0) n_near, case when form_n >= 10 * w.n then form end form, case when form_n >= 10 * w.n then form_n end form_n
    from w left join best using (word)),
walk as (select word, word here, 0 k from f union all select walk.word, f.form, k + 1 from walk join f on f.word = walk.here where f.form is not null),
ends as (select word, arg_max(here, k) root from walk group by 1)
select word, form, root, n, n_near, form_n from f join ends using (word)"""

SQL["op13_prefix_trie"] = rf"""
with turns as (select conv_id c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint w from conversations where conv_id is not null),
own as (select c, list({{'t': t, 'w': w}} order by turn nulls first, t) x from turns group by c),
built as (select a.c, list_concat(case when h > 0 then coalesce(b.x, [])[1:h] else [] end, a.x[h + 1:]) x
    from (select *, ({_crc32('c::varchar')} % 4)::int h from own) a left join own b on b.c = a.c - a.c % 20),
member as (select c, d, len(x) size, array_to_string(list_transform(x[1:d], lambda y: y.t), '') k, case when d > 0 then x[d].w else 0 end w
    from (select *, unnest(range(0, len(x) + 1))::int d from built)),
node as (select d, k, min(c) conv_id, count(*) n_convs, any_value(w) w, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (d = size), '')) ends_sha256
    from member group by d, k),
under as (select d - 1 d, left(k, (d - 1) * 32) k, count(*) n_children from node where d > 0 group by 1, 2),
full_node as (select node.*, coalesce(n_children, 0) n_children from node left join under using (d, k)),
sums as (select d, left(k, d * 32) k, sum((n_children = 0)::int)::bigint n_leaves, sum((n_convs - 1) * w)::bigint saved_tokens
    from (select unnest(range(0, d + 1))::int d, k, n_children, n_convs, w from full_node) group by 1, 2)
select n.conv_id, n.d::bigint as depth, p.conv_id parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from full_node n join sums s using (d, k) left join node p on p.d = n.d - 1 and p.k = left(n.k, (n.d - 1) * 32)"""
