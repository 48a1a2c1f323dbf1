"""The registered queries of this folder, with SQL where it can express them."""

from pyspark.sql import functions as F

from isoplane.llm.collocations import collocations
from isoplane.llm.decontamination import leaks
from isoplane.llm.exact_dedup import exact_duplicates
from isoplane.llm.filter_audit import failure_masks, filter_audit
from isoplane.llm.licenses import AGREE, BASE, NEAR, RARE, TEMPLATES, license_scan
from isoplane.llm.mixing import BLOCK_ROWS, SCALE, mixed
from isoplane.llm.near_duplicates import near_duplicates
from isoplane.llm.quality import fit_network, quality_scores
from isoplane.llm.rarity_digest import edited_likeness, fit_ranks
from isoplane.llm.sharding import histogram_shards, uniform_key
from isoplane.llm.storage import new_folder
from isoplane.llm.token_counts import section_tokens
from isoplane.llm.token_files import read_tokens, write_tokens
from isoplane.llm.url_filter import ALPHABET, HELD_OUT, ORDER, REJECTED_WORDS, RULES, SPAN, STEP, judge_urls

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)`` and its SQL under a name."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_exact_dedup", """
    with d as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(text) as text_sha256
    from d window g as (partition by text)""")
def op10_exact_dedup(spark, sf_dir):
    """Equal texts of all documents; of each group the row with the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def text_or_empty():
    return F.coalesce(F.col("text"), F.lit(""))


@query("op4_histogram_shards", """
    with bits as (select range as v from range(256)),
    steps as (select v, list_reduce([v::bigint] || list_transform(range(8), lambda x: 0::bigint),
        lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as e from bits),
    crc as (select list(e order by v) as t from steps),
    d as (select doc_id, text is null as nothing, coalesce(text, '') as text from documents),
    k as (select doc_id, case when nothing then 0 else strlen(text) end + 1 as size, hex(encode(text)) as h, strlen(text) as n,
        ('0x' || substr(sha256(text), 1, 15))::bigint as k1,
        ('0x' || substr(sha256(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k2 from d),
    b as (select doc_id, size, k1, k2,
        list_transform(range(0, n), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint) as bytes from k),
    c as (select doc_id, size, k1, k2, case when len(bytes) = 0 then 0 else xor(list_reduce([4294967295::bigint] || bytes,
        lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) end as text_crc32 from b, crc),
    o as (select *, sum(size) over (order by k1, k2, doc_id) - size as below, sum(size) over (partition by k1) as grp,
        row_number() over (partition by k1 order by k2, doc_id) as nth, sum(size) over () as total from c),
    edges as (select below as e, total from o where nth = 1 or grp * 8 > total * 0.1
        union all select distinct total, total from o),
    cuts as (select j, arg_min(e, (abs(e * 8 - total * j), e)) as cut from edges, range(1, 8) as r(j) group by j),
    s as (select *, (select count(*) from cuts where cut <= below)::int as shard from o)
    select doc_id, size, text_crc32, 'bytes' as law, shard,
        row_number() over (partition by shard order by k1, k2, doc_id) - 1 as slot, null::int as grown_shard from s""")
def op4_histogram_shards(spark, sf_dir):
    """All documents in eight shards of near-equal bytes, equal texts side by side."""
    text = text_or_empty()
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        uniform_key(text).alias("k1"), uniform_key(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k2"),
        F.col("doc_id").alias("tie"))
    out = histogram_shards(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def license_sql():
    """Templates, phrases and rules of the scan as SQL over all words."""
    rows = lambda items: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in items)
    words = [(t, label, q, w) for t, (label, text, _) in enumerate(TEMPLATES) for q, w in enumerate(text.split())]
    musts = [(t, m, k, w) for t, (_, _, ps) in enumerate(TEMPLATES) for m, p in enumerate(ps) for k, w in enumerate(p.split())]
    base = [(label, k, w, len(p.split())) for label, p in BASE for k, w in enumerate(p.split())]
    return f"""
    with tw(t, label, q, w) as (values {rows(words)}), pw(t, m, k, w) as (values {rows(musts)}),
    bw(label, k, w, n) as (values {rows(base)}),
    vocabulary as (select w from tw union select w from pw union select w from bw),
    lists as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
    words as (select doc_id, w, i - 1 as i from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from lists)
        where w in (select w from vocabulary)),
    df as (select v.w, count(distinct doc_id) as n from vocabulary v left join words using (w) group by v.w),
    ranked as (select t, w, row_number() over (partition by t order by n, w) as r from (select distinct t, w from tw) join df using (w)),
    rare as (select t, w from ranked where r <= {RARE}),
    need as (select t, greatest(1, ceil({AGREE} * count(*))) as least from rare group by t),
    votes as (select doc_id, t, i - q as s, count(distinct w) as n from words join rare using (w) join tw using (t, w) group by all),
    size as (select t, any_value(label) as label, count(*) as len from tw group by t),
    looked as (select doc_id, t, s, label, len from votes join need using (t) join size using (t) where n >= least),
    ends as (select t, m, max(k) + 1 as n from pw group by t, m),
    phrase as (select doc_id, t, m, i - k as pos, count(*) as hits from words join pw using (w) group by all),
    whole as (select doc_id, t, m, pos, n from phrase join ends using (t, m) where hits = n),
    stands as (select doc_id, t, s, label, len, count(distinct m) as ms from looked join whole using (doc_id, t)
        where pos >= greatest(s - {NEAR}, 0) and pos + n <= s + len + {NEAR} group by all),
    accepted as (select doc_id, t, s, label, len from stands join (select t, count(*) as ms from ends group by t) using (t, ms)),
    shares as (select doc_id, t, s, label, count(x.w) / any_value(len) as share from accepted join tw using (t, label)
        left join (select doc_id, w, i from words) x using (doc_id, w) where x.i = s + q group by all),
    bases as (select doc_id, label, i - k as pos from words join bw using (w) group by doc_id, label, i - k having count(*) = any_value(n)),
    b as (select doc_id, count(*) as n, min(pos) as f, max(pos) as l, string_agg(distinct label, ',' order by label) as ls from bases group by doc_id),
    every as (select doc_id, label from bases union select doc_id, label from accepted),
    a as (select doc_id, string_agg(label, ',' order by label) as ls from every group by doc_id),
    best as (select doc_id, max(share) as share from shares group by doc_id)
    select doc_id, len(ws)::bigint as n_words, coalesce(b.n, 0) as n_base, f as first_word, l as last_word,
        coalesce(b.ls, '') as base_labels, coalesce(a.ls, '') as labels, round(coalesce(share, 0), 6)::double as score
    from lists left join b using (doc_id) left join a using (doc_id) left join best using (doc_id)"""


@query("op9_license_index", license_sql())
def op9_license_index(spark, sf_dir):
    """Licence notices of all documents."""
    return license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def url_sql():
    """Rules, both models and the calibration of the URL filter."""
    rules = ", ".join(f"('{v}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', {len(r)}, '{r}')" for v, r in RULES)
    words = ", ".join(f"'{w}'" for w in REJECTED_WORDS)
    fold = []
    for c in "ar":
        for k in range(1, ORDER + 2):
            before = f"select gram, 1.0::double / {ALPHABET} as p from g" if k == 1 else f"select gram, p from p{c}{k - 1}"
            fold.append(f"p{c}{k} as (select b.gram, case when m.n{c} is null or m.n{c} = 0 then p "
                        f"else (m.{c} + m.t{c} * p) / (m.n{c} + m.t{c}) end as p from ({before}) b "
                        f"left join m on m.gram = b.gram and m.size = {k})")
    crc = ("with bits as (select range as v from range(256)), steps as (select v, list_reduce([v::bigint] || "
           "list_transform(range(8), lambda x: 0::bigint), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) "
           "else c >> 1 end) as e from bits), crc as (select list(e order by v) as t from steps)")
    return f"""
    {crc},
    rules(verdict, h, p, n, rule) as (values {rules}),
    u as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
    x as (select *, regexp_replace(host || path, '[0-9]+', '0', 'g') as norm from u),
    d as (select norm, bool_or(list_has_any(regexp_split_to_array(host, '[.-]'), [{words}])) as rejected from x group by norm),
    h as (select *, hex(encode(norm)) as hx, strlen(norm) as n from d),
    b as (select norm, rejected, list_transform(range(0, n), lambda i: ('0x' || substr(hx, (2 * i + 1)::int, 2))::bigint) as bytes from h),
    texts as (select norm, rejected, (case when len(bytes) = 0 then 0 else xor(list_reduce([4294967295::bigint] || bytes,
        lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) end) % {HELD_OUT} <> 0 as fit from b, crc),
    places as (select norm, rejected, fit, '^' || norm || '$' as s, unnest(range(2, length(norm) + 3)) as i from texts),
    grams as (select norm, rejected, fit, substr(s, greatest(1, i - {ORDER}), i - greatest(1, i - {ORDER}) + 1) as gram from places),
    g as (select gram, count(*) filter (where fit and not rejected) as a, count(*) filter (where fit and rejected) as r from grams group by gram),
    parts as (select gram, a, r, unnest(range(1, length(gram) + 1)) as size from g),
    counts as (select right(gram, size) as part, sum(a) as a, sum(r) as r from parts group by 1),
    contexts as (select left(part, length(part) - 1) as context, sum(a) as na, sum(r) as nr, count(*) filter (where a > 0) as ta,
        count(*) filter (where r > 0) as tr from counts group by 1),
    m as (select gram, size, c.a, c.r, na, nr, ta, tr from parts join counts c on c.part = right(gram, size)
        join contexts on context = left(part, length(part) - 1)),
    {', '.join(fold)},
    ratio as (select gram, ln(r.p) - ln(a.p) as ratio from pa{ORDER + 1} a join pr{ORDER + 1} r using (gram)),
    scored as (select norm, rejected, fit, avg(ratio) as score from grams join ratio using (gram) group by all),
    bins as (select floor(least(greatest(score, -{SPAN}), {SPAN}) / {STEP})::bigint as bin, count(*) filter (where rejected) as r,
        count(*) filter (where not rejected) as a from scored where not fit group by 1),
    cum as (select bin, coalesce(lead(bin) over w, bin + 1) as nxt, sum(a) over w as a, sum(r) over w as r, sum(a) over () as aa,
        sum(r) over () as rr from bins window w as (order by bin)),
    gains as (select *, a * rr - r * aa as gain, (bin + 1 + nxt) / 2.0 * {STEP} as edge from cum where aa > 0 and rr > 0),
    cut as (select coalesce((min(edge) + max(edge)) / 2, 0) as cut from gains where gain = (select max(gain) from gains)),
    best as (select host, path, arg_max(rule, n) as rule, arg_max(verdict, n) as verdict from (select distinct host, path from x) y
        join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
    select page_id, x.host, x.path, rule, coalesce(verdict, case when score > cut then 'block' else 'allow' end) as verdict
    from x join scored using (norm) left join best on best.host = x.host and best.path = x.path, cut"""


@query("op6_url_language_model", url_sql())
def op6_url_language_model(spark, sf_dir):
    """A verdict for the URL of every page."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


MIX_SQL = f"""
    with recursive k as (select doc_id, source, ('0x' || substr(sha256(coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
    r as (select *, row_number() over (partition by source order by key, doc_id) - 1 as rank from k),
    n as (select source, count(*) as rows, sqrt(count(*)::double) as target, ceil(count(*) / {BLOCK_ROWS})::bigint as blocks from documents group by source),
    q as (select *, row_number() over (order by source nulls first) - 1 as idx, greatest(1, floor(target / sum(target) over ()
        * least({SCALE}, {1 << 61}::bigint // sum(blocks) over ()) + 0.5))::bigint as share from n),
    g as (select *, share / sum(share) over () as weight, coalesce(sum(blocks) over (w rows between unbounded preceding and 1 preceding), 0)::hugeint as gone,
        sum(share) over (w rows between current row and unbounded following)::hugeint as live from q window w as (order by blocks / share, idx)),
    s as (select *, gone + (live * blocks + share - 1) // share as e from g),
    ends as (select 0::hugeint as e union select e from s),
    phases as (select ends.e, coalesce(sum(blocks) filter (s.e <= ends.e), 0)::hugeint as gone,
        coalesce(sum(share) filter (s.e > ends.e), 0)::hugeint as live from ends, s group by ends.e),
    lists as (select list(blocks order by idx) as bs, list(share order by idx) as ss, list(e order by idx) as es, sum(blocks) as total from s),
    ph as (select list({{'e': e, 'gone': gone, 'live': live}} order by e) as ph from phases),
    walk as (
        select 0::hugeint as t, list_transform(bs, lambda x: 0::hugeint) as done, 0 as k, -1::bigint as idx, -1::hugeint as nth from lists
        union all
        select t + 1, list_transform(done, lambda x, i: x + case when i = p.i then 1 else 0 end), k2, p.i - 1, done[p.i]
        from (select *, list_min(list_filter(list_transform(range(1, len(bs) + 1), lambda i: case when done[i] < bs[i]
                and (es[i] <= t + 1 or done[i] * ph[k2 + 1].live < ss[i] * (t + 1 - ph[k2 + 1].gone))
                then {{'due': (done[i] + 1)::double / ss[i]::double, 'i': i}} end), lambda y: y is not null)) as p
            from (select *, case when k + 2 <= len(ph) and ph[k + 2].e <= t + 1 then k + 1 else k end as k2 from walk, lists, ph where t < total))),
    slots as (select w.idx, w.nth, w.t - 1 as slot, min(x.gone + (x.live * w.nth) // o.share) as release,
            min(x.gone + (x.live * (w.nth + 1) + o.share - 1) // o.share) as deadline
        from walk w join s o using (idx), s x group by all),
    b as (select doc_id, r.source, idx, weight, rank // {BLOCK_ROWS} as block, rank % {BLOCK_ROWS} as row
        from r join s on r.source is not distinct from s.source)
    select doc_id, b.source, weight::double as weight, block, release::bigint as release, deadline::bigint as deadline, slot::bigint as slot,
        (slot * {BLOCK_ROWS} + row)::bigint as place from b join slots on slots.idx = b.idx and nth = block"""


@query("op3_pfair_mix", MIX_SQL)
def op3_pfair_mix(spark, sf_dir):
    """The place of every document in a mix at the square root of its source's size."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def word_vocabulary():
    """Path of the word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_files")
def op2_token_files(spark, sf_dir):
    """Token ids of all documents, written as patched frame-of-reference pages and read back."""
    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), word_vocabulary(), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "page_start")


@query("op1_qgram_leaks")
def op1_qgram_leaks(spark, sf_dir):
    """Every benchmark passage in every document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUALITY_CUT = 0.7


@query("op7_quality_network")
def op7_quality_network(spark, sf_dir):
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_network(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    return quality_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= QUALITY_CUT, 1).otherwise(0).alias("predicted"))


NEAR_SQL = """
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') as ws from documents),
    s as (select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) = 1 then ws
        else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
    sets as (select min(doc_id) as id, sh, len(sh) as n from (select doc_id, list_sort(sh) as sh from s) group by sh having len(sh) > 0),
    members as (select doc_id, id from (select doc_id, list_sort(sh) as sh from s) x join sets using (sh)),
    freq as (select t, count(*) as df from (select unnest(sh) as t from sets) group by t),
    flat as (select id, n, t, row_number() over (partition by id order by df, t) as r from
        (select id, n, unnest(sh) as t from sets) join freq using (t)),
    prefix as (select id, n, t from flat where r <= n - ceil(0.8 * n)::bigint + 1),
    cand as (select distinct a.id as a, b.id as b from prefix a join prefix b using (t)
        where a.id < b.id and least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)),
    sims as (select a, b, x.n + y.n as total, len(list_intersect(x.sh, y.sh)) as shared
        from cand join sets x on x.id = a join sets y on y.id = b),
    links as (select a, b from sims where 100 * shared >= 80 * (total - shared)),
    ways as (select a, b from links union all select b, a from links),
    reach as (select id as node, id as root from sets union select b, root from reach join ways on a = node),
    comp as (select node, min(root) as c from reach group by node)
    select s.doc_id, len(sh)::bigint as n_shingles, coalesce(c, s.doc_id) as component_id, coalesce(c, s.doc_id) = s.doc_id as kept
    from s left join members using (doc_id) left join comp on node = id"""


@query("op5_minhash_bayes", NEAR_SQL)
def op5_minhash_bayes(spark, sf_dir):
    """Groups of all documents that share four fifths of their two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, threshold=0.8).drop("t")


@query("op8_section_tokens")
def op8_section_tokens(spark, sf_dir):
    """Tokens of every line of all documents."""
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

AUDIT_SQL = """
    with l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
    d as (select d.doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, coalesce(good, false) as good,
        coalesce(toxic, false) as toxic from documents d left join l using (doc_id)),
    w as (select *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') as ws from d),
    f as (select part, good, toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), regexp_matches(text, '[#$%&*|]'),
        doc_id > min(doc_id) over (partition by text)] as fails from w),
    m as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
    i as (select unnest(range(1, 6)) as i),
    o as (select [a.i, b.i, c.i, d.i, e.i] as p from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    x as (select part, n, good, toxic, fails, p, k.i as step, p[k.i] as filter,
        len(list_filter(p[1:k.i - 1], lambda q: fails[q])) as earlier, len(list_filter(fails, lambda y: y)) as many from m, o, i k),
    s as (select part, p, step, filter, coalesce(sum(n) filter (earlier = 0 and not fails[filter]), 0)::bigint as kept,
        coalesce(sum(n) filter (earlier = 0 and fails[filter]), 0)::bigint as removed,
        coalesce(sum(n) filter (earlier > 0 and fails[filter]), 0)::bigint as redundant,
        coalesce(sum(n) filter (many = 1 and fails[filter]), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (earlier = 0 and fails[filter]), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (earlier = 0 and fails[filter]), 0)::bigint as toxic_lost from x group by all)
    select part, array_to_string(list_transform(p, lambda q: 'ABCDE'[q]), '') as filter_order, step::int as step, kept, removed, redundant,
        unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from s"""


@query("op12_filter_diagram", AUDIT_SQL)
def op12_filter_diagram(spark, sf_dir):
    """Steps of five filters over all documents in all 120 orders, by language."""
    masks = failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit(masks, list("ABCDE"))


@query("op11_rarity_digest")
def op11_rarity_digest(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts; ranks come from all windows of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_likeness(docs, fit_ranks(docs))


COLLOCATION_SQL = """
    with pieces as (select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    w as (select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') as ws from pieces),
    grams as (select lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(ws) - m + 2),
        lambda i: ws[i:i + m - 1])))) as g from w),
    f as (select lang, g, count(*) as f from grams group by lang, g),
    n as (select lang, sum(f) as n from f where len(g) = 1 group by lang),
    c as (select lang, g, f as a from f where f >= 100 and len(g) > 1),
    k as (select lang, g, a, unnest(range(1, len(g))) as k from c),
    s as (select k.lang, k.g, a, k, l.f as l, r.f as r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score from k
        join f l on l.lang = k.lang and l.g = k.g[1:k] join f r on r.lang = k.lang and r.g = k.g[k + 1:] join n on n.lang = k.lang),
    best as (select *, row_number() over (partition by lang, g order by score, k) as nth from s),
    inside as (select c.lang, d.g from c join c d on c.lang = d.lang and len(c.g) > len(d.g) and c.a >= d.a
        and list_contains(list_transform(range(1, len(c.g) - len(d.g) + 2), lambda i: c.g[i:i + len(d.g) - 1]), d.g)),
    kept as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n::bigint as n, score from best
        where nth = 1 and (lang, g) not in (select lang, g from inside)),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""


@query("op13_phrase_quicksort", COLLOCATION_SQL)
def op13_phrase_quicksort(spark, sf_dir):
    """The 2,000 phrases of every language that stand together most, from the words of all documents."""
    return collocations(table(spark, sf_dir, "documents"))
