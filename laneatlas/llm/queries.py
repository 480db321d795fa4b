"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprint, lines, merkle, mixing, negatives, packing, preferences, quality, secrets, simhash, suffix, token_files
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (quality.remainder() == 0).alias("held_out"), "score", "predicted")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preferences.format_preferences(preferences.conversation_pairs(_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return made.select(
        "conv_id", "n_prompt", F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen_completion", 256).alias("chosen_sha256"), spans("chosen_mask").alias("chosen_mask"),
        F.sha2("rejected_completion", 256).alias("rejected_sha256"), spans("rejected_mask").alias("rejected_mask"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vec_id has the next label; every fiftieth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label, "id % 50 = 0")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases A-Z in the texts whose doc_id has a crc32 that 5 divides."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed={"text": tampered})


_BLANK = r"[\x20\x09-\x0D]"

OP4_SQL = rf"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g')) as text_sha256
  from documents),
g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id,
         count(*) over (partition by text_sha256) as group_size,
         row_number() over (partition by text_sha256 order by n desc, doc_id nulls last) = 1 as kept
  from d)
select doc_id, keep_id, group_size, kept, text_sha256 from g
"""

OP8_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as raw_role,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i,
         count(*) over (partition by conv_id) as n
  from conversations),
a as (
  select conv_id, max(i) as last_i, arg_min(text, i) as first_text, arg_max(text, i) as last_text
  from t where raw_role = 'assistant' group by conv_id),
r as (
  select t.*, case when t.i = a.last_i then (case when a.first_text = a.last_text then '' else a.first_text end) else t.text end as other,
         a.last_i
  from t left join a on t.conv_id is not distinct from a.conv_id),
p as (
  select *, case when bool_or(text <> other) over (partition by conv_id) then last_i - 1 else n end as n_prompt from r),
v as (
  select conv_id, i, n_prompt, raw_role,
         '<|' || replace(role, '<|', '< |') || '|>' || chr(10) as head,
         replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) as body,
         replace(other, '<|', '< |') || chr(10) || '<|end|>' || chr(10) as other_body
  from p),
w as (
  select *, sum(length(head) + length(body)) filter (where i > n_prompt) over (partition by conv_id order by i) as upto,
         sum(length(head) + length(other_body)) filter (where i > n_prompt) over (partition by conv_id order by i) as other_upto
  from v)
select conv_id, any_value(n_prompt)::bigint as n_prompt,
       sha256(coalesce(string_agg(head || body, '' order by i) filter (where i <= n_prompt), '')) as prompt_sha256,
       sha256(coalesce(string_agg(head || body, '' order by i) filter (where i > n_prompt), '')) as chosen_sha256,
       coalesce(string_agg((upto - length(body))::bigint || '-' || (upto - 1)::bigint, ',' order by i) filter (where i > n_prompt and raw_role = 'assistant'), '') as chosen_mask,
       sha256(coalesce(string_agg(head || other_body, '' order by i) filter (where i > n_prompt), '')) as rejected_sha256,
       coalesce(string_agg((other_upto - length(other_body))::bigint || '-' || (other_upto - 1)::bigint, ',' order by i) filter (where i > n_prompt and raw_role = 'assistant'), '') as rejected_mask
from w group by conv_id
"""


OP11_SQL = """
with e as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as a, e.id as b, a.label = e.label as same, list_dot_product(a.v, e.v)::bigint as score
  from e as a join e on a.id <> e.id where a.id % 50 = 0),
p as (select * from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (
  select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b)::int as rank,
         s.b as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select * from n where rank <= 3
"""


def _merkle_sql(depth: int = 6, over: int = 4) -> str:
    """Levels as joins of parents: `depth` levels of leaves of a source and `over` of sources, 16 children each (16 million and 65,536)."""
    coded = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    tree = lambda t, k: f"{t}{k + 1} as (select s, i // 16 as i, (any_value(n) + 15) // 16 as n, string_agg(h, '' order by i) as pre, sha256(string_agg(h, '' order by i)) as h from {t}{k} where n > 1 group by s, i // 16)"
    cut = lambda t, k: f"coalesce(substr({t}{k}.pre, 1, 64 * ({'p' if t == 'l' else 'q'} // {16 ** (k - 1)} % 16)) || substr({t}{k}.pre, 64 * ({'p' if t == 'l' else 'q'} // {16 ** (k - 1)} % 16) + 65), '')"
    put = lambda t, k, h: f"case when {t}{k}.pre is null then {h} else sha256(substr({t}{k}.pre, 1, 64 * ({'p' if t == 'l' else 'q'} // {16 ** (k - 1)} % 16)) || {h} || substr({t}{k}.pre, 64 * ({'p' if t == 'l' else 'q'} // {16 ** (k - 1)} % 16) + 65)) end"
    one = lambda t, k: " union all ".join(f"select s, h from {t}{x} where n = 1" for x in range(k + 1))
    head = f"""
with recursive bits(b, step, c) as (
  select b, 0, b from range(256) r(b) union all
  select b, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where step < 8),
tab as (select list(c order by b) as t from bits where step = 8),
d as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ord(x)::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0 as hit from documents, tab),
a as (
  select doc_id, source as s, sha256(concat({", ".join(map(coded, ("doc_id", "source", "lang", "n_chars", "text")))})) as h,
         case when hit then sha256(concat({", ".join(map(coded, ("doc_id", "source", "lang", "n_chars")))}, {coded("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})) end as changed
  from d),
l0 as (
  select doc_id, coalesce('s' || s, '') as s, h, coalesce(changed, h) as g, count(*) over (partition by s) as n,
         row_number() over (partition by s order by doc_id nulls first, h) - 1 as i
  from a),
"""
    parts = [tree("l", k) for k in range(depth)]
    parts.append(f"u as ({one('l', depth)})")
    parts.append("t0 as (select '' as s, s as name, h, count(*) over () as n, row_number() over (order by s) - 1 as i from u)")
    parts += [tree("t", k) for k in range(over)]
    parts.append(f"top as ({one('t', over)})")
    joins = " ".join(f"left join l{k} on l{k}.s = l0.s and l{k}.i = l0.i // {16**k}" for k in range(1, depth + 1))
    joins_over = " ".join(f"left join t{k} on t{k}.i = q // {16**k}" for k in range(1, over + 1))
    inner = "l0.g"
    steps = []
    for k in range(1, depth + 1):
        steps.append(f"f{k} as (select *, {put('f', k, 'g' if k == 1 else f'g{k - 1}').replace(f'f{k}.pre', f'pre{k}').replace('q //', 'p //')} as g{k} from {'w' if k == 1 else f'f{k - 1}'})")
    parts.append(f"w as (select l0.doc_id, l0.s, l0.h, l0.g, l0.i as p, {', '.join(f'l{k}.pre as pre{k}' for k in range(1, depth + 1))} from l0 {joins})")
    parts += steps
    sib = " || ".join(cut("l", k).replace(f"l{k}.pre", f"pre{k}") for k in range(1, depth + 1))
    parts.append(f"x as (select f{depth}.*, t0.h as subroot, t0.i as q, {sib} as sib from f{depth} join t0 on t0.name = f{depth}.s)")
    parts.append(f"y as (select x.*, {', '.join(f't{k}.pre as over{k}' for k in range(1, over + 1))} from x {joins_over})")
    last = "y"
    for k in range(1, over + 1):
        parts.append(f"o{k} as (select *, {put('t', k, f'g{depth}' if k == 1 else f'e{k - 1}').replace(f't{k}.pre', f'over{k}')} as e{k} from {last})")
        last = f"o{k}"
    sib_over = " || ".join(cut("t", k).replace(f"t{k}.pre", f"over{k}") for k in range(1, over + 1))
    return head + ",\n".join(parts) + f"\nselect doc_id, {last}.h as leaf, subroot, top.h as root, sha256(sib || {sib_over}) as proof_sha256, e{over} as folded_root, e{over} = top.h as verified from {last}, top"


OP13_SQL = _merkle_sql()

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_line_dedup": op2_line_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_preference_format": op8_preference_format,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_scan": op12_secret_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES = {"op4_exact_dedup": OP4_SQL, "op8_preference_format": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
