"""Queries over what responses answered, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from disclens.fixed_values import (
    CATEGORIES,
    CATEGORY_LABELS,
    CITATIONS,
    LETTER_CLOSING,
    LETTER_COMPLETE,
    LETTER_EARLIER_PERIOD,
    LETTER_MISSING,
    LETTER_NOTE,
    LETTER_NOTE_WITH_QUESTIONS,
    LETTER_OPENING,
    LETTER_PHRASES,
    LETTER_QUESTIONS,
    SUPPLEMENTAL_TEXT,
)
from disclens.operators import disclosure as ops
from disclens.operators.scale import dealt
from disclens.plans.basket_queries import STAT_MONEY, STATS_SQL, money, sql, stats
from disclens.plans.registry import query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def case_of(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in values.items()) + " end"


CELLS = """select r.request_id, c.ordinal, c.category, d.status,
  case when d.status is null then 'This adapter did not assess this category.' else d.notes end as notes
  from request r cross join categories c
  left join disclosure d on d.request_id = r.request_id and d.category = c.category"""


@query(
    "jn_09_requests_by_category",
    sql("select request_id, category from request, categories", "request", "categories"),
)
def requests_by_category(t):
    return ops.all_categories(t.request()).select("request_id", "category")


@query(
    "jn_10_left_counts",
    sql(
        """select r.request_id, (select count(*) from identity i where i.request_id = r.request_id) as identities,
        (select count(*) from inference i where i.request_id = r.request_id) as inferences,
        (select count(*) from disclosure d where d.request_id = r.request_id) as disclosures from request r""",
        "request", "identity", "inference", "disclosure",
    ),
)
def left_counts(t):
    df = t.request().select("request_id")
    for name, child in (("identities", t.identity()), ("inferences", t.inference()), ("disclosures", t.disclosure())):
        counted = child.groupBy("request_id").agg(F.count(F.lit(1)).alias(name))
        df = df.join(counted, "request_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return df


@query(
    "agg_17_profile_split",
    sql(
        """select r.request_id, o.origin,
        (select count(*) from inference i where i.request_id = r.request_id and i.origin = o.origin) as inferences,
        (select count(*) from inference i where i.request_id = r.request_id and subject = 'household')
          as household_scoped_count,
        (select count(*) from identity i where i.request_id = r.request_id) as identity_count
        from request r, (values ('first_party_model'), ('appended_third_party'), ('unknown')) o(origin)""",
        "request", "inference", "identity",
    ),
)
def profile_split(t):
    return ops.profile_split(t.request(), t.identity(), t.inference())


@query(
    "agg_18_scope_note",
    sql(
        """select request_id, case when n = 0 then '' when h > 0 then h || ' household-scoped'
        when u = n then 'scope not stated' when u > 0 then u || ' with no scope stated' else 'all individual' end
        as scope_note from (select r.request_id, count(i.identity_seq) as n,
          count(*) filter (scope = 'household') as h, count(i.identity_seq) filter (scope is null) as u
          from request r left join identity i on i.request_id = r.request_id group by 1)""",
        "request", "identity",
    ),
)
def scope_note(t):
    return ops.scope_note(t.request(), t.identity())


@query(
    "agg_19_gauge_position",
    sql(
        """select inference_seq, case when hi > lo then cast(greatest(0, least(100,
          floor((value_num - lo) / (hi - lo) * 100 + 0.5))) as bigint) end as gauge
        from (select *, try_cast(regexp_extract(scale, '(\\d+)[–-](\\d+)', 1) as double) as lo,
          try_cast(regexp_extract(scale, '(\\d+)[–-](\\d+)', 2) as double) as hi from inference)""",
        "inference",
    ),
)
def gauge(t):
    return t.inference().select(
        "inference_seq", ops.gauge_position(F.col("value_num"), F.col("scale")).alias("gauge")
    )


MATRIX_SQL = (
    "select request_id, "
    + ", ".join(f"max(status) filter (category = '{c}') as {c.lower()}" for c in CATEGORIES)
    + f""", count(*) filter (status = 'absent') as absent_count, count(*) filter (status is null) as unassessed_count,
    count(*) filter (status = 'partial') as partial_count from ({CELLS}) group by 1"""
)


@query("agg_20_compliance_matrix", sql(MATRIX_SQL, "request", "categories", "disclosure"))
def compliance_matrix(t):
    return ops.compliance_matrix(t.request(), t.disclosure())


@query("agg_20_compliance_cells", sql(CELLS, "request", "categories", "disclosure"))
def compliance_cells(t):
    return ops.compliance_cells(t.request(), t.disclosure())


@query(
    "agg_21_answered_summary",
    sql(
        f"""select *, case when partial_count = 0 then '' when partial_count < answered
          then ', ' || partial_count || ' of them only in part' when answered = 1 then ', and only in part'
          when answered = 2 then ', both only in part' else ', all ' || answered || ' only in part' end as wording
        from (select request_id, 8 - unassessed_count as assessed, 8 - unassessed_count - absent_count as answered,
          partial_count from ({MATRIX_SQL}))""",
        "request", "categories", "disclosure",
    ),
)
def answered(t):
    return ops.answered_summary(ops.compliance_matrix(t.request(), t.disclosure()))


@query(
    "agg_22_shared_note",
    sql(
        f"""select request_id, case when count(n) >= 2 and count(distinct n) = 1 then min(n) end as shared_note
        from (select request_id, case when status is null or status = 'absent' then notes end as n from ({CELLS}))
        group by 1""",
        "request", "categories", "disclosure",
    ),
)
def shared_note(t):
    return ops.shared_note(ops.compliance_cells(t.request(), t.disclosure()))


@query(
    "agg_23_follow_up_routing",
    sql(
        """select request_id, ord, in_letter, listed, listed and in_letter as asked, listed and not in_letter as about_it
        from (select *, question is not null or kind = 'supplemental_period' as in_letter,
          kind <> 'missing_category' as listed from follow_up)""",
        "follow_up",
    ),
)
def routing(t):
    return ops.follow_up_routing(t.follow_up()).select(
        "request_id", F.col("ord").cast("int").alias("ord"), "in_letter", "listed", "asked", "about_it"
    )


@query(
    "agg_24_compare",
    sql(
        f"""select s.request_id, r.display_name, s.disclosed, s.lines_disclosed, s.basket_count as visits,
        s.total_stated, s.total_paid, s.total_shelf, s.total_saved, s.distinct_products,
        case when i.n > 0 or s.zero_claimable then i.n end as identifier_count,
        case when f.n > 0 then f.n end as inference_count,
        case when f.a > 0 or (s.zero_claimable and f.n > 0) then f.a end as appended_inference_count,
        case when r.retailer_id <> 'generic' and d.assessed = 8 then d.absent end as absent_disclosures
        from ({STATS_SQL}) s join request r on r.request_id = s.request_id
        join (select r.request_id, count(identity_seq) as n from request r left join identity i
              on i.request_id = r.request_id group by 1) i on i.request_id = s.request_id
        join (select r.request_id, count(inference_seq) as n, count(*) filter (origin = 'appended_third_party') as a
              from request r left join inference i on i.request_id = r.request_id group by 1) f
          on f.request_id = s.request_id
        left join (select request_id, count(*) as assessed, count(*) filter (status = 'absent') as absent
              from disclosure group by 1) d on d.request_id = s.request_id""",
        "pieces", "raw_basket", "dim", "identity", "inference", "disclosure",
    ),
)
def compare(t):
    side = ops.compare(t.request(), stats(t), t.identity(), t.inference(), t.disclosure())
    return side.select(*[c for c in side.columns if c not in STAT_MONEY], *money(*STAT_MONEY))


@query(
    "agg_24_comparable",
    sql("select count(*) > 1 as comparable, count(*) as requests from request", "request"),
)
def comparable(t):
    return ops.comparable(t.request())


LETTER_SQL = f"""select r.request_id,
  'To: ' || display_name || ' Privacy Office' || chr(10) || 'Subject: Supplemental request under the CCPA'
  || case when report_reference is null then '' else ' (your reference ' || report_reference || ')' end
  || {quoted(LETTER_OPENING)}
  || coalesce({quoted(LETTER_MISSING)} || d.bullets, {quoted(LETTER_COMPLETE)})
  || case when coalesce(f.earlier, false) then {quoted(LETTER_EARLIER_PERIOD)} else '' end
  || coalesce({quoted(LETTER_QUESTIONS)} || q.questions, '')
  || {quoted(LETTER_CLOSING)} as letter,
  case when q.questions is null then {quoted(LETTER_NOTE)} else {quoted(LETTER_NOTE_WITH_QUESTIONS)} end as note
from request r
left join (select request_id, string_agg(chr(10) || '  - ' || {case_of('category', LETTER_PHRASES)}
      || ' (Civ. Code § ' || {case_of('category', CITATIONS)} || ')'
      || case when status = 'partial' then ', which your response addressed only in part' else '' end,
      '' order by status = 'partial', ordinal) as bullets
    from disclosure where status <> 'provided' group by 1) d on d.request_id = r.request_id
left join (select request_id, bool_or(kind = 'supplemental_period') as earlier from follow_up group by 1) f
  on f.request_id = r.request_id
left join (select request_id, string_agg(chr(10) || '  ' || n || '. ' || question, '' order by ord) as questions
    from (select *, row_number() over (partition by request_id order by ord) as n from follow_up
          where question is not null) group by 1) q on q.request_id = r.request_id"""


@query("agg_26_letter", sql(LETTER_SQL, "request", "disclosure", "follow_up"))
def letter(t):
    return ops.letters(t.request(), t.disclosure(), t.follow_up())


@query(
    "ext_24_absent_completion",
    sql(
        """select r.request_id, c.category, coalesce(d.status, 'absent') as status, d.evidence
        from request r cross join categories c left join (select * from disclosure where status <> 'absent') d
          on d.request_id = r.request_id and d.category = c.category""",
        "request", "categories", "disclosure",
    ),
)
def absent_completion(t):
    found = t.disclosure().where("status <> 'absent'").select("request_id", "category", "status", "evidence")
    return ops.absent_completion(found, t.request(), "request_id").select(
        "request_id", "category", "status", "evidence"
    )


@query(
    "ext_30_follow_up_rows",
    sql(
        f"""select d.request_id, 'missing_category' as kind, 'Ask ' || r.display_name || ' to disclose '
          || {case_of('category', CATEGORY_LABELS)} || ', which the response did not address.' as description
        from disclosure d join request r on r.request_id = d.request_id where status = 'absent'
        union all
        select doc_id, 'supplemental_period', replace({quoted(SUPPLEMENTAL_TEXT)}, '{{year}}',
          regexp_extract(text, '(?i)prior to\\s+(\\d{{4}})', 1))
        from (select doc_id, text || case when doc_id % 3 = 0 then ' Data prior to ' || (1990 + doc_id % 9) else '' end
              as text from document) where regexp_matches(text, '(?i)prior to\\s+(\\d{{4}})')""",
        "request", "disclosure", "document",
    ),
)
def follow_up_rows(t):
    from disclens.operators.extract_text import supplemental_rows

    absent = t.disclosure().join(t.request().select("request_id", "display_name"), "request_id")
    letters = t.document().select(
        F.col("doc_id").alias("request_id"),
        F.expr("concat(text, case when doc_id % 3 = 0 then concat(' Data prior to ', 1990 + doc_id % 9) else '' end)")
        .alias("text"),
    )
    return (
        ops.missing_category_rows(absent, F.col("display_name"))
        .unionByName(supplemental_rows(letters))
        .select("request_id", "kind", "description")
    )


@query(
    "set_01_union_of_follow_ups",
    sql(
        """select request_id, kind, description from follow_up union all
        select request_id, 'warning', message from parse_warning""",
        "follow_up", "parse_warning",
    ),
)
def union_of_follow_ups(t):
    warnings = t.parse_warning().select(
        "request_id", F.lit("warning").alias("kind"), F.col("message").alias("description")
    )
    return t.follow_up().select("request_id", "kind", "description").unionByName(warnings)


@query(
    "set_02_missing_categories",
    sql(
        "select request_id, category from request, categories except select request_id, category from disclosure",
        "request", "categories", "disclosure",
    ),
)
def missing_categories(t):
    return ops.all_categories(t.request()).select("request_id", "category").join(
        dealt(t.disclosure().select("request_id", "category")), ["request_id", "category"], "left_anti"
    )
