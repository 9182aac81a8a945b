"""The opN_ queries over whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chats, fingerprints, manifest, media, mixing, neighbours, pieces, quality, secrets, simhash, toxicity, urls
from .common import held_out, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.scheduled(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("row.doc_id", "source", "block", "place", "slot", "release", "deadline")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.load()
    decoded = pieces.decode_pieces(pieces.encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_ids", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_media(table(spark, sf_dir, "documents")).drop("n_bytes")
    return media.media_digests(media.read_media(stored))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "hits")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    coder = chats.Coder()
    return chats.read_back(chats.pack(rows, coder), coder)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.compare_with_next(docs, fingerprints.entropy_ranks(docs))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier, op2_mixing_sources, op3_sentencepiece, op4_media_columns, op5_toxicity, op6_url_filter, op7_chat_format, op8_secret_scan, op9_document_fingerprints,
        op10_simhash_components, op11_nearest_neighbours, op12_merkle_manifest, op13_filter_audit,
    )
    return {f.__name__: f for f in found}


#: Words, failures and orders for themselves; orders are all arrangements of five letters.
FILTER_AUDIT = """
with recursive texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
counted as (
  select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by t) as least from texts),
failing as (
  select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > least, false) as e
  from counted),
labelled as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic from labels where doc_id is not null group by doc_id),
fails as (
  select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as f,
    count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as bad
  from failing left join labelled using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders(o) as (select '' union all select o || x from orders join letters on not contains(o, x)),
steps as (select o as filter_order, unnest(range(1, 6)) as step from orders where length(o) = 5),
met as (
  select part, filter_order, step, substr(filter_order, step, 1) as x, f, n, good, bad,
    (select min(i) from (select unnest(range(1, 6)) as i) where contains(f, substr(filter_order, i, 1))) as gone
  from fails cross join steps),
summed as (
  select part, filter_order, step, x, coalesce(sum(n) filter (where gone is null or gone > step), 0) as kept, coalesce(sum(n) filter (where gone = step), 0) as removed,
    coalesce(sum(n) filter (where contains(f, x) and gone < step), 0) as redundant, coalesce(sum(n) filter (where f = x), 0) as unique_fails,
    coalesce(sum(good) filter (where gone = step), 0) as good_lost, coalesce(sum(bad) filter (where gone = step), 0) as toxic_lost
  from met group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley
from summed"""

#: A field of a leaf; a CRC-32 bit by bit; trees level by level.
_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::varchar", "source", "lang", "({0})::varchar", "text")) + ")"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), "
    "lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda y, i: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295)"
)
MERKLE = f"""
with recursive leaves as (
  select doc_id, lang, {_LEAF.format('n_chars')} as leaf, case when coalesce({_CRC} % 7 = 0, false) then {_LEAF.format('n_chars + 1')} else {_LEAF.format('n_chars')} end as tried from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from leaves),
tree(lang, level, place, n, h) as (
  select lang, 0, place, n, leaf from placed
  union all
  select lang, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by place)) from tree where n > 1 group by lang, level, place // 2),
subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from tree where n = 1),
top(level, place, n, h) as (
  select 0, place, n, h from subroots
  union all
  select level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by place)) from top where n > 1 group by level, place // 2),
walk(lang, place, doc_id, level, pos, n, up, sofar, fold) as (
  select lang, place, doc_id, 0, place, n, 0, '', tried from placed
  union all
  select w.lang, w.place, w.doc_id, case when w.n > 1 then w.level + 1 else 0 end, case when w.n > 1 then w.pos // 2 when w.up = 0 then s.place else w.pos end,
    case when w.n > 1 then (w.n + 1) // 2 else s.n end, case when w.n > 1 then w.up else 1 end,
    case when w.n > 1 then w.sofar || coalesce(t.h, u.h, '') else w.sofar end,
    case when w.n = 1 then w.fold when w.pos % 2 = 1 then sha256(coalesce(t.h, u.h) || w.fold) else sha256(w.fold || coalesce(t.h, u.h, '')) end
  from walk w join subroots s on s.lang is not distinct from w.lang
  left join tree t on w.up = 0 and t.lang is not distinct from w.lang and t.level = w.level and t.place = xor(w.pos, 1)
  left join top u on w.up = 1 and u.level = w.level and u.place = xor(w.pos, 1)
  where w.n > 1 or w.up = 0)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, sha256(w.sofar) as proof_sha256, w.fold as folded_root, w.fold = r.h as verified
from walk w join placed p on p.lang is not distinct from w.lang and p.place = w.place join subroots s on s.lang is not distinct from w.lang, (select h from top where n = 1) r
where w.up = 1 and w.n = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": MERKLE, "op13_filter_audit": FILTER_AUDIT}
