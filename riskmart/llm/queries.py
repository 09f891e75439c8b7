"""One query per operator over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm import (
    bpe,
    decontaminate,
    filter_audit,
    fingerprint,
    jaccard,
    language_model,
    pack,
    packed_files,
    phrases,
    quality,
    repeats,
    token_counts,
    urls,
    warc,
)
from riskmart.llm.components import store
from riskmart.llm.ship import ship
from riskmart.sources import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = f"{shared_dir(spark)}/packed-{uuid4().hex}"
    packed_files.write(pack.pack(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), out)
    return packed_files.read(spark, out)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), archive)
    return warc_digest(warc.read(spark, archive, payload=False))


def warc_digest(records: DataFrame) -> DataFrame:
    """Records with the length of the payload that they stand for; a revisit has it from its response."""
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = store(records.withColumnRenamed("stated_bytes", "payload_bytes").select(*columns), "records")
    responses, revisits = (found.filter(F.col("record_type") == kind) for kind in ("response", "revisit"))
    originals = responses.select(
        F.col("page_id").alias("original"), F.col("payload_digest").alias("original_digest"), "payload_bytes"
    ).drop_duplicates(["original", "original_digest"])
    of_original = F.col("original").eqNullSafe(F.col("refers_to")) & (F.col("original_digest") == F.col("payload_digest"))
    resolved = revisits.drop("payload_bytes").join(originals, of_original)
    return responses.unionByName(resolved.select(*columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scan(documents, benchmark))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_counts.token_counts(documents, public_tokenizers.path("byte_bpe_50k.json"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def bpe_digest(documents: DataFrame) -> DataFrame:
    """Encode, decode again, and digest both."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.encode(documents, ranks), ranks)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        quality.is_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.fit(documents.filter(~language_model.is_held_out("doc_id")))
    scored = language_model.score(documents, model)
    return scored.select(
        "doc_id",
        language_model.is_held_out("doc_id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def _shipping(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    q.__name__: _shipping(q)
    for q in (
        op1_pack,
        op2_url_filter,
        op3_warc,
        op4_decontaminate,
        op5_token_counts,
        op6_repeats,
        op7_jaccard_join,
        op8_bpe,
        op9_fingerprint,
        op10_quality,
        op11_language_model,
        op12_filter_audit,
        op13_collocations,
    )
}

SHINGLES = """
    list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i : i + 4], 'string_agg', ' ')) end)"""

WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"

ORACLES = {
    "op13_collocations": """
        with doc as (
            select row_number() over () as d, coalesce(lang, 'und') as lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents),
        piece as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from doc),
        worded as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from piece),
        total as (select lang, sum(len(w))::bigint as n from worded group by lang),
        word as (select lang, unnest(w) as w1, unnest(list_concat(w[2:], [null])) as w2,
            unnest(list_concat(w[3:], [null, null])) as w3, unnest(list_concat(w[4:], [null, null, null])) as w4
            from worded where len(w) > 0),
        f as (
            select lang, 1 as length, w1 as phrase, count(*) as f from word where w1 is not null group by lang, w1
            union all
            select lang, 2, w1 || ' ' || w2, count(*) from word where w2 is not null group by lang, w1, w2
            union all
            select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from word where w3 is not null group by lang, w1, w2, w3
            union all
            select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*)
            from word where w4 is not null group by lang, w1, w2, w3, w4),
        candidate as (select lang, length, phrase, f as a, string_split(phrase, ' ') as w from f where length > 1 and f >= 30),
        cut as (
            select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f::hugeint + y.f) as score
            from (select *, unnest(range(1, length)) as k from candidate) c
            join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
            join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
        lowest as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        inner_phrase as (
            select lang, array_to_string(w[i : i + size - 1], ' ') as phrase, max(a) as longer
            from (select *, unnest(range(1, length - size + 2)) as i
                from (select *, unnest(range(2, length)) as size from candidate where length > 2))
            group by all),
        best as (
            select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank
            from lowest s left join inner_phrase i on i.lang = s.lang and i.phrase = s.phrase
            where coalesce(100::hugeint * i.longer < 80::hugeint * s.a, true))
        select lang, rank, phrase, a, l, r, n, score::bigint as score from best join total using (lang) where rank <= 2000""",
    "op12_filter_audit": """
        with doc as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
            from documents),
        failed as (
            select doc_id, part,
                (len(w) < 100)::int
                + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
                + 8 * regexp_matches(text, '[#$%&*|]')::int
                + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
            from doc),
        mark as (
            select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic
            from labels where doc_id is not null group by doc_id),
        cell as (
            select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
            from failed left join mark using (doc_id) group by part, mask),
        subset as (select unnest(range(32)) as s),
        alive as (
            select part, s, sum(case when mask & s = 0 then n else 0 end) as n,
                sum(case when mask & s = 0 then good else 0 end) as good,
                sum(case when mask & s = 0 then toxic else 0 end) as toxic
            from cell, subset group by part, s),
        letter as (select unnest(range(5)) as i),
        ordering as (
            select [a.i, b.i, c.i, d.i, e.i] as o
            from letter a, letter b, letter c, letter d, letter e
            where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        place as (
            select o, k as step, o[k] as f,
                list_sum(list_transform(o[1 : k], lambda x: 1 << x))::int as after_s
            from ordering, (select unnest(range(1, 6)) as k)),
        change as (
            select t.part, p.o, p.step, p.f, t.n as kept, b.n - t.n as removed, b.good - t.good as good_lost,
                b.toxic - t.toxic as toxic_lost, z.n - one.n as failing, rest.n - whole.n as unique_fails
            from place p
            join alive t on t.s = p.after_s
            join alive b on b.s = p.after_s - (1 << p.f) and b.part = t.part
            join alive z on z.s = 0 and z.part = t.part
            join alive one on one.s = (1 << p.f) and one.part = t.part
            join alive rest on rest.s = 31 - (1 << p.f) and rest.part = t.part
            join alive whole on whole.s = 31 and whole.part = t.part)
        select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') as filter_order, step::int as step,
            kept::bigint as kept, removed::bigint as removed, (failing - removed)::bigint as redundant,
            unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
            (sum(removed) over (partition by part, f))::bigint as shapley
        from change""",
    "op3_warc": """
        with page as (
            select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes,
                sha256(coalesce(html, '')) as payload_digest
            from pages),
        judged as (
            select *, min(page_id) over (partition by payload_digest) as first_id from page)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from judged""",
    "op7_jaccard_join": f"""
        with recursive doc as (
            select row_number() over () as row_id, doc_id,
                {WORDS.format(text="coalesce(text, '')", pattern="[^\\x20\\x09-\\x0D]+")} as w
            from documents),
        sets as (select row_id, doc_id, {SHINGLES} as s from doc),
        shingle as (select row_id, len(s) as n, unnest(s) as shingle from sets),
        link as (
            select a.row_id as x, b.row_id as y
            from shingle a join shingle b on a.shingle = b.shingle and a.row_id <> b.row_id
            group by a.row_id, b.row_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach as (
            select row_id as x, row_id as y from sets
            union
            select r.x, l.y from reach r join link l on r.y = l.x),
        class as (
            select row_id, min(row_id) over same as class,
                case when len(s) > 0 then min(doc_id) over same else doc_id end as class_id
            from sets window same as (partition by list_sort(s))),
        links as (
            select l.x, count(distinct b.class) as n_links
            from link l join class a on l.x = a.row_id join class b on l.y = b.row_id
            where a.class <> b.class group by l.x)
        select s.doc_id, len(s.s) as n_shingles, c.component_id, k.class_id, coalesce(n.n_links, 0) as n_links
        from sets s join (
            select r.x, min(t.doc_id) as component_id from reach r join sets t on r.y = t.row_id group by r.x) c
            on c.x = s.row_id
        join class k on k.row_id = s.row_id left join links n on n.x = s.row_id""",
    "op4_decontaminate": f"""
        with item as (
            select item_id, {WORDS.format(text="coalesce(text, '')", pattern='[0-9a-z[:^ascii:]]+')} as w
            from benchmark),
        item_window as (
            select item_id, list_slice(w, i, i + least(len(w), 10) - 1) as words
            from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
        doc as (
            select row_number() over () as row_id, doc_id,
                {WORDS.format(text="coalesce(text, '')", pattern='[0-9a-z[:^ascii:]]+')} as w
            from documents),
        width as (select distinct len(words) as n from item_window),
        doc_window as (
            select row_id, i, n, list_slice(w, i, i + n - 1) as words
            from (select row_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, width where len(w) >= n)),
        found as (
            select d.row_id, d.i, d.n, t.item_id from doc_window d join item_window t on d.words = t.words),
        hits as (
            select row_id, count(distinct place) as n_hit
            from (select row_id, unnest(range(i, i + n)) as place from found) group by row_id),
        items as (
            select row_id, count(*) as n_items, string_agg(item, ',' order by item) as list
            from (select distinct row_id, item_id::varchar as item from found where item_id is not null)
            group by row_id)
        select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items,
            sha256(coalesce(t.list, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
        from doc d left join hits h using (row_id) left join items t using (row_id)""",
}
