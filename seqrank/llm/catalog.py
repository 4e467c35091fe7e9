"""The queries of this subpackage: one for each operator, over its whole table, with DuckDB twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqrank.llm import alignment, chat, content_sort, decontaminate, html, licences, quality, sentencepieces, simhash, spellings, urls, vectors, warc
from seqrank.llm.registry import QUERIES, SQL, query, table

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

#: Names in hosts whose pages the block list holds.
LISTED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track")


@query(
    "op1_warc_seekable",
    """
    with p as (select page_id, url, coalesce(html,'') payload from pages),
    d as (select page_id, url, strlen(payload) payload_bytes, sha1(payload) h, max(page_id) over (partition by payload) latest from p)
    select page_id, payload_bytes::bigint payload_bytes,
        array_to_string(list_transform(range(0,8), lambda i: array_to_string(list_transform([15,10,5,0], lambda s:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x'||substr(h,(i*5+1)::int,5))::bigint >> s) & 31)+1)::int, 1)), '')), '') payload_digest,
        case when page_id < latest then 'revisit' else 'response' end record_type,
        case when page_id < latest then latest end refers_to, url
    from d
    """,
)
def op1(spark, folder):
    return warc.archive_round_trip(table(spark, folder, "pages"))


_PARTS = rf"""
    a as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') rest from pages),
    b as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}, {_LOWER}) host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) q from a),
    c as (select *, array_to_string(list_sort(list_filter(string_split(q,'&'), lambda p: p <> '' and not starts_with(p,'utm_'))), '&') kept from b),
    d as (select *, case when host = '' then '' else regexp_replace(host,'^www\.','') || regexp_replace(path,'/+$','')
            || case when kept = '' then '' else '?' || kept end end canonical from c)
"""


@query(
    "op2_url_bloom",
    f"""
    with {_PARTS},
    listed as (select distinct canonical from d where canonical <> '' and len(list_intersect(string_split(host,'.'), {list(LISTED_NAMES)})) > 0),
    r as (select d.*, l.canonical is not null is_listed, case
            when (host = 'example.net' or host like '%.example.net') and starts_with(path,'/en/') then 'example.net/en/'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path,'/de/') then 'example.com/de/'
            when (host = 'org' or host like '%.org') and starts_with(path,'/fr/') then 'org/fr/'
            when (host = 'net' or host like '%.net') and starts_with(path,'/') then 'net/' end rule
        from d left join listed l using (canonical))
    select page_id, host, path, rule, case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow'
        when 'org/fr/' then 'allow' else case when is_listed then 'block' else 'allow' end end verdict, is_listed from r
    """,
)
def op2(spark, folder):
    pages = table(spark, folder, "pages")
    host, _, _ = urls.parts(F.col("url"))
    bad = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_NAMES)))
    return urls.judge(pages, pages.where(bad).select(urls.canonical(F.col("url")).alias("canonical")).distinct())


@query(
    "op3_html_trees",
    # what the article elements of these pages hold: the answer, by another way
    r"""
    with a as (select page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') x from pages),
    b as (select page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') x from a),
    c as (select page_id, url, replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') x from b),
    d as (select page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) text from c)
    select page_id, url, text, length(text)::bigint n_chars from d
    """,
)
def op3(spark, folder):
    pages = table(spark, folder, "pages")
    return html.main_texts(pages, html.learn(pages))


@query("op4_sentencepiece")
def op4(spark, folder):
    return sentencepieces.encode_documents(table(spark, folder, "documents"))


@query("op5_quality_gam")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))


#: Where the query places a document: below its source, in a folder of 2,000 and one of 200 ids. The first ones of a folder are its licence files.
_PATH = """concat(source, '/d', {div}(doc_id, 2000), case when doc_id % 2000 < 20 then '/LICENSE'
    when doc_id % 200 < 20 then concat('/e', {div}(doc_id, 200), '/LICENSE') else concat('/e', {div}(doc_id, 200), '/', doc_id, '.txt') end)"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licences.TEMPLATES))
_TERMS = r"list_filter(string_split_regex(translate({}, {}, {}), '[^a-z0-9]+'), lambda w: w <> '')"
_TEXT_TERMS, _DOC_TERMS = _TERMS.format("text", _UPPER, _LOWER), _TERMS.format("coalesce(text,'')", _UPPER, _LOWER)


@query(
    "op6_licence_scan",
    f"""
    with f as (select doc_id, text, {_PATH.replace("{div}(doc_id, 2000)", "doc_id // 2000").replace("{div}(doc_id, 200)", "doc_id // 200")} path from (select * from documents)),
    t(template, licence, text) as (values {_TEMPLATES}),
    tt as (select template, unnest({_TEXT_TERMS}) term from t),
    vocab as (select distinct term from tt),
    n as (select count(*)::double n from f),
    seen as (select term, count(*) df from (select distinct doc_id, unnest({_DOC_TERMS}) term from f) join vocab using (term) group by 1),
    idf as (select term, 1 + ln((n + 1) / (1 + coalesce(df, 0))) idf from vocab left join seen using (term), n),
    hl as (select doc_id, unnest(list_filter(string_split_regex(coalesce(text,''), '[\r\n]+'), lambda l: regexp_matches(translate(l, {_UPPER}, {_LOWER}), '{licences.MARKS}'))) text from f),
    l as (select distinct text from hl),
    lt as (select text line, unnest({_TEXT_TERMS}) term from l),
    lr as (select line, term, count(*) * coalesce(any_value(idf), 1 + ln((select n from n) + 1)) raw from lt left join idf using (term) group by 1, 2),
    lw as (select line, term, raw / sqrt(sum(raw*raw) over (partition by line)) w from lr),
    tr as (select template, term, count(*) * any_value(idf) raw from tt join idf using (term) group by 1, 2),
    tw as (select template, term, raw / sqrt(sum(raw*raw) over (partition by template)) w from tr),
    c as (select line, template, round(sum(lw.w * tw.w), 6) score from lw join tw using (term) group by 1, 2),
    b as (select line, licence, score, row_number() over (partition by line order by score desc, licence) k from c join t using (template) where score >= {licences.LEAST_COSINE}),
    o as (select doc_id, licence, score from (select doc_id, licence, score, row_number() over (partition by doc_id order by score desc, licence) k from hl join b on hl.text = b.line where b.k = 1) where k = 1),
    p as (select f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) dir, path like '%/LICENSE' speaks, licence, score from f left join o using (doc_id)),
    s as (select dir, licence, score from (select dir, licence, score, row_number() over (partition by dir order by score desc, licence) k from p where speaks and licence is not null) where k = 1),
    near as (select p.doc_id, s.dir, s.licence, s.score, row_number() over (partition by p.doc_id order by length(s.dir) desc) k from p join s on p.dir = s.dir or starts_with(p.dir, s.dir || '/') where p.licence is null)
    select p.doc_id, path, coalesce(p.licence, near.licence) licence, coalesce(p.score, near.score) score,
        case when p.licence is not null then 'own' when near.licence is not null then 'inherited' end origin, near.dir licence_dir
    from p left join near on p.doc_id = near.doc_id and near.k = 1
    """,
)
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    path = _PATH.replace("{div}(doc_id, 2000)", "doc_id div 2000").replace("{div}(doc_id, 200)", "doc_id div 200")
    return licences.scan(docs.select("doc_id", "text", F.expr(path).alias("path")))


@query(
    "op7_vector_pivots",
    """
    with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings where label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
    reach as (select a node, a least from links union select l.a, r.least from reach r join links l on l.b = r.node),
    c as (select node, min(least) component_id from reach group by 1),
    n as (select a, count(*) n from links group by 1)
    select vec_id, coalesce(n.n, 0)::bigint n_links, coalesce(c.component_id, vec_id) component_id, coalesce(c.component_id, vec_id) = vec_id kept
    from embeddings left join c on c.node = vec_id left join n on n.a = vec_id
    """,
)
def op7(spark, folder):
    return vectors.near_vectors(table(spark, folder, "embeddings"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text,''), {}, {}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(_UPPER, _LOWER)


@query(
    "op8_positional_index",
    f"""
    with i as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
    iw as (select distinct item, least(10, len(w)) n, array_to_string(w[p0+1:p0+least(10,len(w))], ' ') gram from (select item, w, unnest(range(0, len(w) - least(10,len(w)) + 1)) p0 from i where len(w) > 0)),
    d as (select doc_id, {_WORDS} w from documents),
    g as (select doc_id, n, p0, array_to_string(w[p0+1:p0+n], ' ') gram from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) p0 from d, (select distinct n from iw) where len(w) >= n)),
    m as (select doc_id, p0, g.n, item from g join iw on g.n = iw.n and g.gram = iw.gram),
    h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(p0, p0+n)) p from m) group by 1),
    t as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from m group by 1)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit,0)::bigint n_hit, coalesce(n_items,0)::bigint n_items, sha256(coalesce(items,'')) items_sha256, n_hit is not null contaminated
    from d left join h using (doc_id) left join t using (doc_id)
    """,
)
def op8(spark, folder):
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_UNSAFE = r"\\|<\|turn\|>|<\|end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>"


@query(
    "op9_chat_offsets",
    rf"""
    with r as (select conv_id, turn, coalesce(role,'') role, coalesce(text,'') text, role ro, text tx from conversations
        union all select -1, k, role, '</s>[INST] ok [/INST]', role, 'x' from (values (0,'user'),(1,'assistant')) v(k, role))
    select conv_id, count(*)::bigint n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, ro nulls first, tx nulls first)) turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, tx nulls first) filter (role = 'assistant'), '')) loss_sha256,
        sum(length(text) + length(role) + len(regexp_extract_all(text, '{_UNSAFE}')) + len(regexp_extract_all(role, '{_UNSAFE}')) + 8 + 7 + 1)::bigint formatted_chars
    from r group by conv_id
    """,
)
def op9(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat.format_digests(rows.union(own)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op10_simhash_anchors")
def op10(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query(
    "op11_spelling_trees",
    # deletion neighbourhoods instead of trees; crc32 by its table of 256 entries, which a rule gives
    f"""
    with recursive tab as (select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], [0::bigint,0,0,0,0,0,0,0]),
            lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
    r as (select doc_id::varchar || ':' || run s, run from (select doc_id,
        unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), '[A-Za-zÀ-ÿ]+')) run from documents)),
    c as (select run, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), 2*i::int+1, 2))::bigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::int + 1])), 4294967295) h from r, tab),
    d as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word from c),
    w as (select word, count(*) n from d where length(word) >= 7 group by 1 having count(*) >= 2),
    cut as (select word, n, p, substr(word, 1, p-1) || substr(word, p+1) rest from (select word, n, unnest(range(1, length(word)+1))::int p from w)),
    near as (select a.word, b.word other from cut a join cut b on a.p = b.p and a.rest = b.rest and a.word <> b.word
        union select cut.word, w.word from cut join w on cut.rest = w.word union select w.word, cut.word from cut join w on cut.rest = w.word),
    best as (select near.word, count(*) n_near, max(w.n) top from near join w on w.word = near.other group by 1),
    lead as (select near.word, min(near.other) form, any_value(top) form_n from near join best using (word) join w on w.word = near.other join w own on own.word = near.word
        where w.n = top and top >= 10 * own.n group by 1),
    walk as (select word, word root, 0 k from w union all select walk.word, lead.form, k + 1 from walk join lead on lead.word = walk.root),
    ends as (select word, arg_max(root, k) root from walk group by 1)
    select w.word, lead.form, ends.root, w.n, coalesce(n_near, 0)::bigint n_near, form_n from w join ends using (word) left join best using (word) left join lead using (word)
    """,
)
def op11(spark, folder):
    return spellings.group_variants(spellings.document_words(table(spark, folder, "documents"), damage=31))


@query("op12_lockstep_alignment")
def op12(spark, folder):
    return alignment.alignment_digests(table(spark, folder, "documents"))


@query(
    "op13_content_sort",
    """
    select doc_id, max(doc_id) over t keep_id, count(*) over t group_size, doc_id = max(doc_id) over t kept, sha256(coalesce(text,'')) text_sha256
    from documents window t as (partition by coalesce(text,''))
    """,
)
def op13(spark, folder):
    return content_sort.exact_duplicates(table(spark, folder, "documents"), keep="largest")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
