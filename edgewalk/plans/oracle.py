"""SQL twins of the catalogue's queries, written for themselves against the same tables."""

from __future__ import annotations

from .catalog import BATCH, CLASSES, CONFIG, FULL_STEPS, PER_NODE, SEED, STEPS

_D = CONFIG.dataset


def draw(*parts: str) -> str:
    """SQL of a 60-bit draw; parts are SQL expressions."""
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) as bigint)"


_LABEL = "case l_returnflag when 'R' then -1 when 'A' then 0 else 1 end"
_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

COPURCHASE = f"""edges as (
  select {_KEY} as edge_key, l_orderkey as major, l_linenumber as minor, l_partkey as u, nxt as v, {_LABEL} as label
  from (select *, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as nxt from lineitem) t
  where nxt is not null)"""
TRADE = f"""edges as (
  select {_KEY} as edge_key, l_orderkey as major, l_linenumber as minor, c_nationkey as u, s_nationkey as v, {_LABEL} as label
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""
BIPARTITE = f"""edges as (
  select {_KEY} as edge_key, l_orderkey as major, l_linenumber as minor, o_custkey as u, l_suppkey + 10000000 as v, {_LABEL} as label
  from lineitem join orders on l_orderkey = o_orderkey)"""

SPLIT = f"""ranked as (
  select *, row_number() over (order by {draw(str(SEED), 'edge_key')}, edge_key, u, v, label) - 1 as rk, count(*) over () as n_all from edges),
sized as (select *, floor(cast({_D.train_ratio} as double) * n_all) as a, floor(cast({_D.mask_ratio} as double) * n_all) as b, floor(cast({_D.val_ratio} as double) * n_all) as c from ranked),
split as (select edge_key, u, v, label, case when rk < a then 0 when rk < a + b then 1 when rk < a + b + c then 2 else 3 end as split_id from sized),
lookup as (select u, v, label, min(split_id) as split_id from split group by u, v, label)"""

WALK = f"""adj as (select u, v, label, row_number() over (partition by u order by v, label) - 1 as k, count(*) over (partition by u) as deg from edges),
degs as (select distinct u, deg from adj),
nodes as (select u, row_number() over (order by {draw(str(SEED), "'start'", 'u')}, u) - 1 as pick, count(*) over () as n_nodes from degs),
begun as (select w.i as walk_id, nodes.u as node from (select unnest(range({PER_NODE} * (select count(*) from nodes))) as i) w join nodes on nodes.pick = {draw(str(SEED), 'w.i', '0')} % nodes.n_nodes),
walk as (
  select walk_id, 0 as step, node, null::bigint as frm, null::integer as label from begun
  union all
  select walk.walk_id, walk.step + 1, adj.v, walk.node, adj.label
  from walk join degs on degs.u = walk.node join adj on adj.u = walk.node and adj.k = {draw(str(SEED), 'walk.walk_id', 'walk.step + 1')} % degs.deg
  where walk.step < {STEPS}),
tokens as (
  select walk_id, 2 * step as pos, 'N_' || node as token from walk
  union all
  select walk_id, 2 * step - 1, 'E_' || label from walk where step > 0)"""

VOCAB = """firsts as (
  select token, 0 as s, walk_id as a, pos as b, '' as c, 0 as d from tokens
  union all select 'N_' || u, 1, major, minor, edge_key, 0 from edges
  union all select 'N_' || v, 1, major, minor, edge_key, 1 from edges
  union all select 'E_' || label, 1, major, minor, edge_key, 2 from edges),
met as (select token, min((s, a, b, c, d)) as place from firsts group by token),
vocab as (
  select token, row_number() over (order by place, token) + 2 as token_id from met
  union all select * from (values ('<PAD>', 0), ('<MASK>', 1), ('<UNK>', 2)) r(token, token_id)),
classes as (select token, token_id, row_number() over (order by token_id) - 1 as class_id from vocab where starts_with(token, 'E_'))"""

ENCODED = """near as (select *, lag(token) over (partition by walk_id order by pos) as before, lead(token) over (partition by walk_id order by pos) as behind from tokens),
encoded as (
  select walk_id, pos, token_id, coalesce(split_id, -1) as split_id
  from (select near.*, vocab.token_id from near join vocab using (token)) n
  left join lookup on starts_with(token, 'E_') and 'N_' || lookup.u = before and 'N_' || lookup.v = behind and 'E_' || lookup.label = token)"""


def _padded(length: str) -> str:
    return f"""padded as (
  select * from encoded
  union all
  select walk_id, p, 0, -1 from (select walk_id, max(pos) as last from encoded group by walk_id) e, unnest(range(e.last + 1, {length})) t(p))"""


PADDED = _padded("(select max(pos) + 1 from encoded)")
VIEWS = """stages as (select * from (values ('train', 1), ('val', 2), ('test', 3)) s(stage, t)),
views as (
  select stage, walk_id, pos, case when split_id >= t then 1 else token_id end as x,
    case when split_id = t then coalesce(class_id, -1) else -1 end as label, case when token_id <> 0 and split_id <= t then 1 else 0 end as attn
  from padded cross join stages left join classes using (token_id))"""

FULL_WALK = WALK.replace(f"walk.step < {STEPS}", f"walk.step < {FULL_STEPS}")
BASE = f"with recursive {COPURCHASE}, {SPLIT}, {WALK}"
ALL = f"{BASE}, {VOCAB}, {ENCODED}, {PADDED}, {VIEWS}"

SCORED = """scored as (select vec_id as id, label as target, list_transform(embedding[1:10], lambda x: x::double) as s from embeddings),
cells as (select id, target, i - 1 as class_id, s[i] as z from scored, range(1, 11) t(i)),
soft as (select id, target, class_id, z, exp(z - max(z) over (partition by id)) / sum(exp(z - m)) over (partition by id) as p from (select *, max(z) over (partition by id) as m from cells) c),
preds as (select id, target, arg_max(class_id, (z, -class_id)) as prediction from cells group by id, target)"""
MATRIX = """matrix as (
  select a.i as "true", b.i as pred, count(p.id) as n from range(10) a(i) cross join range(10) b(i)
  left join preds p on p.target = a.i and p.prediction = b.i group by a.i, b.i)"""
OVR = """ovr as (select class_id, z as score, sum(case when target = class_id then 1 else 0 end) as pos, sum(case when target <> class_id then 1 else 0 end) as neg from cells group by class_id, z)"""
CURVE = """curve as (
  select class_id, score, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by class_id) as p, sum(neg) over (partition by class_id) as q
  from ovr window w as (partition by class_id order by score desc rows unbounded preceding)),
rates as (select *, case when p > 0 then tp / p::double end as tpr, case when q > 0 then fp / q::double end as fpr from curve)"""
COMBOS = """combos as (
  select row_number() over (order by a, b) - 1 as combo, h as nhead, e as emb
  from (values (0, 1), (1, 2), (2, 4), (3, 8), (4, 16)) x(a, h), (values (0, 4), (1, 8), (2, 16), (3, 32), (4, 64), (5, 128)) y(b, e) where e % h = 0)"""
TRIALS = """trials as (
  select o_orderkey as trial, o_orderpriority as study, case when o_orderstatus = 'F' then 'COMPLETE' else 'PRUNED' end as state,
    case when o_orderkey % 7 <> 0 then round(o_totalprice / 1e6, 4) end as val_auc, o_custkey % 30 as combo from orders)"""


def _i(*columns: str) -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in columns)


def _r(*columns: str) -> str:
    return ", ".join(f"round(cast({c} as double), 6) as {c}" for c in columns)


def _u(name: str) -> str:
    return f"({draw(str(SEED), repr(name), 'trial')}::double / {float(1 << 60)})"


def _histogram(edges: str) -> str:
    return f"with {edges} select {_i('label')}, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from edges group by label"


def _tokens(edges: str, walk: str = WALK) -> str:
    return f"with recursive {edges}, {walk} select {_i('walk_id', 'pos')}, token from tokens"


def _stage(stage: str) -> str:
    return f"{ALL} select {_i('walk_id', 'pos', 'x', 'label', 'attn')} from views where stage = '{stage}'"


def _per_stage(inner: str, outer: str) -> str:
    return f"{ALL}, per as ({inner}) {outer}"


_DENSE = lambda n: f"dense as (select i as class_id, count(v.label) as n from range({n}) c(i) left join views v on v.label = c.i and v.stage = 'train' group by i)"
_EPOCHS = (min(15, CONFIG.training.epochs // 4), min(100, CONFIG.training.epochs))


STAGE_METRICS = f"""with {SCORED}, cl as (select id, case when id % 11 = 0 then -1 else target end as target, prediction, ['train', 'val', 'test'][id % 3 + 1] as stage, id // 3 % 2 as epoch from preds),
    pr as (select cl.*, class_id, p from cl join soft using (id)), ok as (select * from pr where target <> -1),
    loss as (select stage, epoch, count(*) as n, avg(-ln(p)) as loss from ok where class_id = target group by all),
    k as (select stage, epoch, class_id, count(*) filter (target = class_id and prediction = class_id) as tp, count(*) filter (target = class_id and prediction <> class_id) as fn, count(*) filter (target <> class_id and prediction = class_id) as fp from ok group by all),
    macro as (select stage, epoch, avg(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end) as accuracy, avg(2.0::double * tp / (2 * tp + fp + fn)) as f1 from k where tp + fn + fp > 0 group by all),
    r as (select stage, epoch, class_id, target, rank() over (partition by stage, epoch, class_id order by p) + (count(*) over (partition by stage, epoch, class_id, p) - 1) / 2.0::double as rk from ok),
    g as (select stage, epoch, class_id, count(*) filter (target = class_id) as a, count(*) filter (target <> class_id) as b, sum(rk) filter (target = class_id) as s from r group by all),
    area as (select stage, epoch, avg(case when a > 0 and b > 0 then (s - a * (a + 1) / 2.0::double) / (a * b::double) end) as auroc from g group by all)
    select stage, cast(epoch as bigint) as epoch, n, round(loss, 6) as loss, round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(auroc, 6) as auroc from loss join macro using (stage, epoch) join area using (stage, epoch)"""


def oracle_sql() -> dict[str, str]:
    ints = lambda name, a, b: f"cast(floor({a} + {_u(name)} * {b - a + 1}) as bigint) as {name}"
    choice = lambda name, *c: f"cast(([{', '.join(map(str, c))}])[cast(floor({_u(name)} * {len(c)}) as integer) + 1] as bigint) as {name}"
    floats = lambda name, a, b: f"round({a} + {_u(name)} * {b - a!r}, 6) as {name}"
    logs = lambda name, a, b: f"round(ln({a!r}::double) + {_u(name)} * (ln({b!r}::double) - ln({a!r}::double)), 6) as log_{name}"
    summary = f"{ALL} select stage, count(*) as positions, count(distinct walk_id) as walks, cast(min(x) as bigint) as least_x, cast(max(x) as bigint) as most_x, round(100.0::double * count(*) filter (x = 0) / count(*), 6) as padded, round(100.0::double * count(*) filter (label = -1) / count(*), 6) as ignored, round(100.0::double * count(*) filter (attn = 1) / count(*), 6) as attended from views group by stage"
    log_ints = lambda name, a, b: f"cast(floor(exp(ln({a!r}::double) + {_u(name)} * (ln({b!r}::double) - ln({a!r}::double)))) as bigint) as {name}"
    return {
        "edge_label_histogram": _histogram(COPURCHASE),
        "trade_label_histogram": _histogram(TRADE),
        "node_stats": f"with {COPURCHASE} select count(*) as nodes, min(x) as least, max(x) as most from (select u as x from edges union select v from edges) t",
        "parse_edge_text": f"with {TRADE} select {_i('u', 'v', 'label')}, count(*) as n from edges group by u, v, label",
        "binary_positive": f"with {TRADE} select cast(label as bigint) as rating, cast(label > 0 as bigint) as binary_rating, count(*) as n from edges group by label",
        "rating_profile": f"with {TRADE} select count(*) as n, cast(min(label) as bigint) as least, cast(max(label) as bigint) as most, count(*) filter (label > 0) as n_positive, count(*) filter (label <= 0) as n_other from edges",
        "binary_dominant": f"with {TRADE}, c as (select label, count(*) as n from edges group by label) select cast(label as bigint) as rating, cast(label = (select label from c order by n desc, label limit 1) as bigint) as binary_rating, n from c",
        "dominant_profile": f"with {TRADE}, c as (select label, count(*) as n from edges group by label) select cast(label as bigint) as rating, n, round(100.0::double * n / sum(n) over (), 6) as percent, cast(label = (select label from c order by n desc, label limit 1) as bigint) as is_dominant from c",
        "dedup_edges_ordered": f"with {TRADE} select edge_key, {_i('major', 'minor', 'u', 'v', 'label')} from (select *, row_number() over (partition by u, v, label order by major, minor, edge_key) as r from edges) t where r = 1",
        "sampled_edges": f"with {COPURCHASE} select edge_key, {_i('u', 'v', 'label')} from edges order by {draw(str(SEED), repr('sample'), 'edge_key')}, edge_key, u, v, label limit 20",
        "split_edges": f"with {COPURCHASE}, {SPLIT} select {_i('u', 'v', 'label', 'split_id')}, count(*) as n from split group by u, v, label, split_id",
        "split_sizes": f"with {TRADE}, {SPLIT}, c as (select split_id, count(*) as n from (select distinct u, v, label, split_id from split) t group by split_id) select cast(s.i as bigint) as split_id, s.name as split, coalesce(c.n, 0) as n, round(100.0::double * coalesce(c.n, 0) / (select sum(n) from c), 6) as percent from (values (0, 'train'), (1, 'mask'), (2, 'val'), (3, 'test')) s(i, name) left join c on c.split_id = s.i",
        "split_label_dist": f"with {COPURCHASE}, {SPLIT} select {_i('split_id', 'label')}, count(*) as n from (select distinct u, v, label, split_id from split) t group by split_id, label",
        "split_overlap": f"with {TRADE}, {SPLIT}, t as (select distinct u, v, label, split_id from split) select cast(p.a as bigint) as a, cast(p.b as bigint) as b, count(y.u) as n from (select x.i as a, y.i as b from range(4) x(i), range(4) y(i) where x.i < y.i) p left join t x on x.split_id = p.a left join t y on y.split_id = p.b and y.u = x.u and y.v = x.v and y.label = x.label group by p.a, p.b",
        "split_precedence": f"with {TRADE}, {SPLIT} select {_i('u', 'v', 'label', 'split_id')} from lookup",
        "adjacency_degree": f"with {BIPARTITE} select {_i('u')}, count(*) as deg, count(distinct (v, label)) as distinct_out from edges group by u",
        "random_walks": _tokens(COPURCHASE),
        "random_walks_joined": _tokens(COPURCHASE),
        "full_walks": _tokens(COPURCHASE, FULL_WALK),
        "full_walks_joined": _tokens(COPURCHASE, FULL_WALK),
        "full_stage_summary": summary.replace(WALK, FULL_WALK),
        "walks_bipartite_sinks": _tokens(BIPARTITE),
        "walk_length_stats": f"with recursive {COPURCHASE}, {WALK} select count(*) as walks, min(n) as least, max(n) as most, round(avg(n), 6) as mean from (select walk_id, count(*) as n from tokens group by walk_id) t",
        "walk_token_types": f"with recursive {COPURCHASE}, {WALK}, c as (select count(*) filter (starts_with(token, 'N_')) as nodes, count(*) filter (starts_with(token, 'E_')) as edges from tokens) select nodes, edges, round(nodes / edges::double, 6) as ratio from c",
        "vocab_table": f"{BASE}, {VOCAB} select token, {_i('token_id')} from vocab",
        "class_map": f"{BASE}, {VOCAB} select token, {_i('token_id', 'class_id')} from classes",
        "vocab_composition": f"{BASE}, {VOCAB} select count(*) as vocab_size, count(*) filter (starts_with(token, 'N_')) as nodes, count(*) filter (starts_with(token, 'E_')) as edges, count(*) filter (starts_with(token, '<')) as special from vocab",
        "encode_roundtrip": f"{BASE}, {VOCAB}, asked as (select token as was from tokens union all select * from (values ('N_x'), ('E_99'), ('<PAD>')) o(t)) select was, coalesce(v.token, '<UNK>') as token, cast(coalesce(v.token_id, 2) as bigint) as token_id, count(*) as n from asked left join vocab v on v.token = asked.was group by all",
        "parsed_tokens": f"{BASE}, {VOCAB} select token, case when starts_with(token, 'N_') then cast(substr(token, 3) as bigint) end as node, case when starts_with(token, 'E_') then cast(substr(token, 3) as bigint) end as edge_label, cast(starts_with(token, 'N_') as bigint) as is_node, cast(starts_with(token, 'E_') as bigint) as is_edge from vocab",
        "label_roundtrip": f"{BASE}, {VOCAB} select v.token as was, coalesce(c.token, '<UNK_LABEL>') as token, cast(coalesce(c.class_id, -1) as bigint) as class_id from vocab v left join classes c using (token)",
        "edge_context": f"with recursive {COPURCHASE}, {WALK} select {_i('walk_id', 'pos')}, token, before, behind from (select *, lag(token) over (partition by walk_id order by pos) as before, lead(token) over (partition by walk_id order by pos) as behind from tokens) t where starts_with(token, 'E_')",
        "encoded_walks": f"{BASE}, {VOCAB}, {ENCODED} select {_i('walk_id', 'pos', 'token_id', 'split_id')} from encoded",
        "padded_walks": f"with recursive {BIPARTITE}, {SPLIT}, {WALK}, {VOCAB}, {ENCODED}, {_padded(str(2 * STEPS + 1))} select {_i('walk_id', 'pos', 'token_id', 'split_id')} from padded",
        "stage_train": _stage("train"),
        "stage_val": _stage("val"),
        "stage_test": _stage("test"),
        "stage_packed": f"{ALL} select {_i('walk_id')}, string_agg(x, ',' order by pos) as x, string_agg(label, ',' order by pos) as labels, string_agg(attn, ',' order by pos) as attn from views where stage = 'val' group by walk_id",
        "stage_summary": summary,
        "stage_sparsity": f"{ALL} select stage, count(*) as positions, count(*) filter (label <> -1) as valid, count(*) filter (attn = 1 and label = -1) as attended_unlabelled, round(100.0::double * count(*) filter (attn = 1 and label = -1) / count(*) filter (attn = 1), 6) as attended_unlabelled_percent from views group by stage",
        "seq_length_stats": _per_stage("select stage, walk_id, sum(attn) as n from views group by stage, walk_id", f"select stage, cast(min(n) as bigint) as least, cast(max(n) as bigint) as most, cast(quantile_disc(n, 0.5) as bigint) as median, count(*) filter (n >= {2 * STEPS + 1}) as \"full\", round(avg(n), 6) as mean from per group by stage"),
        "token_frequency": f"{ALL} select {_i('x')}, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from views where stage = 'train' group by x",
        "token_usage": f"{ALL} select round(100.0::double * count(*) filter (x = 0) / count(*), 6) as pad, round(100.0::double * count(*) filter (x = 1) / count(*), 6) as mask, count(distinct x) filter (x > 2) as distinct_content from views where stage = 'train'",
        "class_counts_dense": f"{ALL}, {_DENSE(CLASSES + 1)} select {_i('class_id')}, n from dense",
        "class_imbalance": f"{ALL}, {_DENSE(CLASSES)} select round(max(n) / greatest(min(n), 1)::double, 6) as ratio, cast(max(n) / greatest(min(n), 1)::double > 2 as bigint) as imbalanced from dense",
        "targets_attended": _per_stage("select stage, walk_id, count(*) as n, bool_and(attn = 1) as seen, bool_and(x = 1) as masked from views where label <> -1 group by stage, walk_id", "select stage, count(*) as walks, cast(sum(n) as bigint) as targets, count(*) filter (seen) as all_attended, count(*) filter (masked) as all_masked from per group by stage"),
        "target_positions": f"{ALL} select stage, {_i('walk_id')}, coalesce(string_agg(pos, ',' order by pos) filter (label <> -1), '') as targets, coalesce(string_agg(pos, ',' order by pos) filter (x = 1), '') as masked, coalesce(string_agg(pos, ',' order by pos) filter (x = 0), '') as padded from views group by stage, walk_id",
        "batch_skipping": _per_stage(f"select stage, walk_id // {BATCH} as b, count(*) filter (label <> -1) as valid, count(*) as positions from views group by stage, b", "select stage, count(*) as batches, count(*) filter (valid = 0) as skipped, min(valid) filter (valid > 0) as least, max(valid) filter (valid > 0) as most, round(100.0::double * count(*) filter (valid = 0) / count(*), 6) as skipped_percent, round(100.0::double * sum(valid) / sum(positions), 6) as label_percent, round(avg(valid) filter (valid > 0), 6) as mean from per group by stage"),
        "train_batches": f"with {COPURCHASE} select cast(b as bigint) as batch_id, count(*) as walks, min(i) as least, max(i) as most from (select i, (row_number() over (order by {draw(str(SEED), repr('batch'), 'i')}, i) - 1) // {BATCH} as b from (select unnest(range({PER_NODE} * (select count(distinct u) from edges))) as i) t) x group by b",
        "label_density": _per_stage("select stage, walk_id, count(*) filter (label <> -1) as n from views group by stage, walk_id", "select stage, count(*) as walks, min(n) as least, max(n) as most, round(avg(n), 6) as mean from per where n > 0 group by stage"),
        "class_weights": f"{ALL}, {_DENSE(CLASSES + 1)} select {_i('class_id')}, n, round(case when n > 0 then sum(n) over () / (count(*) over () * n)::double else 1.0 end, 6) as weight from dense",
        "present_class_weights": f"{ALL}, c as (select label as class_id, count(*) as n from views where stage = 'train' and label <> -1 group by label) select {_i('class_id')}, n, round(sum(n) over () / (count(*) over () * n)::double, 6) as weight from c",
        "softmax_argmax": f"with {SCORED} select {_i('id')}, cast(prediction as bigint) as prediction, {_i('class_id')}, round(p, 6) as p from soft join preds using (id)",
        "weighted_ce": f"with {SCORED}, w as (select target, 1.0::double * sum(count(*)) over () / (10 * count(*)) as w from preds group by target) select round(avg(-ln(p)), 6) as plain, round(sum(w * -ln(p)) / sum(w), 6) as weighted, count(*) as n from soft join w using (target) where class_id = target",
        "confusion_matrix": f'with {SCORED}, {MATRIX} select {_i("pred", "n")}, cast("true" as bigint) as "true" from matrix',
        "label_confusion": 'select a.i as "true", b.i as pred, count(l.doc_id) as n from range(2) a(i) cross join range(2) b(i) left join labels l on l.quality = a.i and l.toxic = b.i group by a.i, b.i',
        "confusion_normalized": f'with {SCORED}, {MATRIX} select cast("true" as bigint) as "true", {_i("pred")}, round(case when sum(n) over (partition by "true") > 0 then n / (sum(n) over (partition by "true"))::double end, 6) as share from matrix',
        "macro_accuracy_f1": f'with {SCORED}, {MATRIX}, k as (select a.i as c, (select n from matrix where "true" = a.i and pred = a.i) as tp, (select sum(n) from matrix where "true" <> a.i and pred = a.i) as fp, (select sum(n) from matrix where "true" = a.i and pred <> a.i) as fn from range(10) a(i)) select round(avg(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end), 6) as accuracy, round(avg(2.0::double * tp / (2 * tp + fp + fn)), 6) as f1, count(*) as classes from k where tp + fp + fn > 0',
        "roc_points": f"with {SCORED}, {OVR}, {CURVE} select {_i('class_id', 'tp', 'fp')}, {_r('score', 'tpr', 'fpr')} from rates",
        "roc_area": f"with {SCORED}, {OVR}, {CURVE}, s as (select class_id, (fpr - coalesce(lag(fpr) over w, 0)) * (tpr + coalesce(lag(tpr) over w, 0)) / 2 as a from rates window w as (partition by class_id order by score desc)) select {_i('class_id')}, round(sum(a), 6) as area from s group by class_id",
        "auroc_ovr": f"with {SCORED}, r as (select class_id, target, rank() over (partition by class_id order by z) + (count(*) over (partition by class_id, z) - 1) / 2.0::double as rk from cells), g as (select class_id, count(*) filter (target = class_id) as p, count(*) filter (target <> class_id) as q, sum(rk) filter (target = class_id) as s from r group by class_id) select {_i('class_id')}, p as positives, q as negatives, round(case when p > 0 and q > 0 then (s - p * (p + 1) / 2.0::double) / (p * q::double) end, 6) as auroc from g",
        "macro_auroc": f"with {SCORED}, g as (select a.class_id, avg(case when a.z > b.z then 1.0::double when a.z = b.z then 0.5 else 0 end) as x from cells a join cells b on a.class_id = b.class_id and a.target = a.class_id and b.target <> b.class_id group by a.class_id) select round(avg(x), 6) as auroc, count(x) as classes from g",
        "stage_metrics": STAGE_METRICS,
        "merged_stage_metrics": STAGE_METRICS,
        "step_table": f"""with {SCORED}, cl as (select id, case when id % 11 = 0 then -1 else target end as target, ['train', 'val', 'test'][id % 3 + 1] as stage, id // 3 % 2 as epoch from preds),
            x as (select cl.*, case when target = -1 then -1 else id % 5 end as batch_id, (select -ln(p) from soft where soft.id = cl.id and class_id = cl.target) as nll from cl)
            select stage, cast(epoch as bigint) as epoch, cast(batch_id as bigint) as batch_id, count(*) as n, count(*) filter (target <> -1) as labelled, round(avg(nll), 6) as loss, cast(count(*) filter (target <> -1) = 0 as bigint) as skipped from x group by stage, epoch, batch_id""",
        "positional_encoding": f"with recursive {COPURCHASE}, {WALK}, at_pos as (select pos, count(*) as n from tokens group by pos) select {_i('pos')}, d.i as i, round(case when d.i % 2 = 0 then sin(pos * exp(-(d.i - d.i % 2) * (ln(10000.0::double) / 16))) else cos(pos * exp(-(d.i - d.i % 2) * (ln(10000.0::double) / 16))) end, 6) as value, n from at_pos, range(16) d(i)",
        "combo_decode": f"with {COMBOS}, {TRIALS}, t as (select combo - 1 as i, count(*) as n from trials group by combo) select cast(t.i as bigint) as combo, {_i('nhead', 'emb')}, n from t left join combos on combos.combo = t.i",
        "search_space": f"with {COMBOS} select trial, {_i('nhead', 'emb')}, {ints('max_walk_length', 10, 100)}, {log_ints('num_walks', 100_000.0, 5_000_000.0)}, {choice('batch_size', 32, 64, 128, 256, 512)}, {choice('hidden_dim', 4, 8, 16, 32, 64, 128, 256)}, {ints('nlayers', 1, 6)}, {ints('early_stopping_patience', 5, 20)}, {ints('epochs', *_EPOCHS)}, {floats('dropout', 0.0, 0.7)}, {floats('gradient_clip_val', 0.1, 2.0)}, {logs('lr', 1e-5, 1e-1)}, {logs('weight_decay', 1e-8, 1e-1)} from (select i as trial, cast(floor({_u('combo').replace('trial', 'i')} * 27) as bigint) as combo from (select distinct o_custkey as i from orders) t) t join combos using (combo)",
        "trial_topk": f"with {TRIALS} select row_number() over (order by val_auc desc, trial) as rank, {_i('trial')}, study, round(val_auc, 6) as val_auc from trials where state = 'COMPLETE' and val_auc is not null order by val_auc desc, trial limit 10",
        "trial_leaderboard": f"with {TRIALS}, {COMBOS}, x as (select *, coalesce(val_auc, -1) as y from trials where state = 'COMPLETE'), k as (select * from (select *, row_number() over (partition by study order by y desc, trial) as r from x) t where r <= 10), b as (select * from k order by y desc, study, trial limit 10) select row_number() over (order by y desc, study, trial) as rank, {_i('trial')}, study, round(y, 6) as val_auc, {_i('nhead', 'emb')} from b left join combos using (combo)",
        "best_trial": f"with {TRIALS} select {_i('trial')}, round(val_auc, 6) as val_auc from trials where state = 'COMPLETE' and val_auc is not null order by trials.val_auc desc, trials.trial limit 1",
        "scalar_last_values": "select event_type as tag, max(event_id) as step, round(arg_max(value, event_id), 6) as value from events group by event_type",
        "scalar_summary": "select count(value) as n, round(min(value), 6) as least, round(max(value), 6) as most, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events",
        "pruned_reports": "with r as (select o_orderkey as trial, month(o_orderdate) as step, o_totalprice as value from orders), m as (select *, quantile_cont(value, 0.5) over (partition by step order by trial rows between unbounded preceding and 1 preceding) as median from r) select cast(trial as bigint) as trial, cast(step as bigint) as step, round(value, 6) as value, cast(coalesce(trial >= 5 and step >= 5 and value < median, false) as bigint) as prune from m",
        "event_files": "with e as (select 'run-' || (user_id % 4) as run, event_type as tag, event_id as step, cast(cast(value as float) as double) as value from events where value is not null) select run, tag, count(*) as n, max(step) as step, round(arg_max(value, step), 6) as last, round(min(value), 6) as least, round(max(value), 6) as most from e group by run, tag",
        "retention": "select o_orderpriority as folder, o_orderkey as name from (select *, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey) as r from orders) t where r > 5",
    }
