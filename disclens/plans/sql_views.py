"""Derived tables of the SQL checks, written as a SQL user would, not as the operators are."""

from __future__ import annotations

from disclens.fixed_values import CHARGE_WORDS, REGISTER_DEPOSIT

_WORDS = ", ".join(f"'{w}'" for w in CHARGE_WORDS)


def clean(x: str) -> str:
    stripped = rf"regexp_replace({x}, '^\s*\$\s*\d+(?:[.,]\d+)?\s+', '')"
    return rf"trim(regexp_replace({stripped}, '^[^\p{{L}}\p{{N}}]+', ''))"


def charge(x: str) -> str:
    tokens = rf"list_filter(regexp_split_to_array(upper({x}), '\s+'), lambda w: w <> '')"
    return f"""(len({tokens}) > 0 and len(list_filter({tokens}, lambda w: w not in ({_WORDS}))) = 0
        or regexp_matches(array_to_string({tokens}, ' '), '{REGISTER_DEPOSIT}'))"""


def near(ratio: str) -> str:
    return f"""case when round_even({ratio}, 0) >= 2
        and abs({ratio} - round_even({ratio}, 0)) <= cast(0.02 as double) * round_even({ratio}, 0)
        then cast(round_even({ratio}, 0) as bigint) end"""


# division at four places, halves away from zero, in whole ten-thousandths
def over(amount: str, count: str) -> str:
    units = f"cast(cast({amount} as decimal(18,4)) * 10000 as hugeint)"
    return f"""case when {count} is null then cast({amount} as decimal(18,4)) else
        cast(cast(sign({units}) * ((2 * abs({units}) + {count}) // (2 * {count})) as decimal(24,0)) * 0.0001 as decimal(18,4)) end"""


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_basket": (
        ("txn", "txn_item"),
        """select t.txn_id, any_value(t.request_id) as request_id, any_value(t.occurred_at) as occurred_at,
          any_value(t.store_code) as store_code, any_value(t.total_pre_discount) as total_pre_discount,
          count(i.item_id) as item_count, count(i.retail_amt) as shelf_lines,
          coalesce(sum(case when i.retail_amt is not null or i.loyalty_amt is not null
                       then coalesce(i.retail_amt, i.loyalty_amt) end), 0) as shelf_total,
          coalesce(sum(case when i.retail_amt is not null or i.loyalty_amt is not null
                       then coalesce(i.loyalty_amt, i.retail_amt) end), 0) as paid_total
        from txn t left join txn_item i on i.txn_id = t.txn_id group by t.txn_id""",
    ),
    "settled": (
        ("raw_basket",),
        """select txn_id, request_id, occurred_at, store_code, total_pre_discount, item_count,
          item_count > 0 as lines_disclosed,
          case when item_count > 0 and shelf_lines > 0 then shelf_total end as shelf_total,
          case when item_count > 0 then paid_total end as paid_total,
          case when item_count > 0 and shelf_lines > 0 then shelf_total - paid_total end as saved_total,
          case when item_count > 0 and shelf_lines > 0 then shelf_total - total_pre_discount end as delta
        from raw_basket""",
    ),
    "months": (
        ("settled",),
        """select request_id, left(occurred_at, 7) as month, count(*) as visits,
          count(*) filter (lines_disclosed) as itemised, count(*) filter (not lines_disclosed) as unitemised,
          case when count(*) filter (lines_disclosed) = 0
            then coalesce(sum(total_pre_discount) filter (not lines_disclosed), 0)
            else coalesce(sum(paid_total) filter (lines_disclosed), 0) end as paid,
          coalesce(sum(saved_total) filter (lines_disclosed), 0) as saved,
          coalesce(sum(total_pre_discount) filter (not lines_disclosed), 0) as stated,
          min(pos) as first_index
        from (select *, row_number() over (partition by request_id order by occurred_at, txn_id) - 1 as pos
              from settled)
        group by 1, 2""",
    ),
    "pieces": (
        ("request", "disclosure", "txn"),
        """select r.request_id,
          coalesce(d.status = 'provided' or (d.status = 'partial'
             and exists (select 1 from txn t where t.request_id = r.request_id)), false) as disclosed,
          coalesce(d.status = 'provided', false) as zero_claimable
        from request r left join disclosure d
          on d.request_id = r.request_id and d.category = 'SPECIFIC_PIECES'""",
    ),
    "purchase": (
        ("txn", "txn_item"),
        """select i.* exclude occurred_at, coalesce(nullif(upc, ''), nullif(description_raw, '')) as product_key,
          t.occurred_at, left(t.occurred_at, 10) as on_date
        from txn_item i join txn t on t.txn_id = i.txn_id
        where coalesce(nullif(upc, ''), nullif(description_raw, '')) is not null
          and coalesce(retail_amt, loyalty_amt) > 0""",
    ),
    "vote": (
        ("purchase",),
        f"""select request_id, product_key, description_raw as raw,
          coalesce(nullif({clean('description_raw')}, ''), description_raw) as folded,
          count(*) as n, max(nullif(upc, '')) as upc, min(on_date) as first_seen, max(on_date) as last_seen
        from purchase group by 1, 2, 3, 4""",
    ),
    "entry": (
        ("vote",),
        """select request_id, product_key, max(upc) as upc,
          (select folded from (select folded, sum(n) as s from vote w
             where w.request_id = v.request_id and w.product_key = v.product_key group by folded)
             order by s desc, folded limit 1) as label
        from vote v group by request_id, product_key""",
    ),
    "member": (
        ("entry",),
        f"""select request_id, product_key,
          case when count(*) over g > 1 and count(upc) over g = 0
            then first_value(product_key) over (partition by request_id, name
                 order by length(product_key), product_key) else product_key end as key,
          count(*) over g > 1 and count(upc) over g = 0 as joined
        from (select *, coalesce(nullif(upper({clean('label')}), ''), upper(label)) as name from entry)
        window g as (partition by request_id, name)""",
    ),
    "dim": (
        ("vote", "member"),
        f"""select *, {clean('raw')} = '' or {charge('label')} as refused,
           case when joined then label else raw end as match_name from (
          select request_id, key, max(upc) as upc, bool_or(joined) as joined, sum(n) as purchases,
            min(first_seen) as first_seen, max(last_seen) as last_seen,
            arg_min(folded, place) as label, arg_min(best_raw, place) as raw
          from (
            select request_id, key, folded, upc, joined, n, first_seen, last_seen, best_raw,
              row_number() over (partition by request_id, key order by fold_n desc, folded) as place
            from (
              select m.key, m.joined, v.*, sum(n) over f as fold_n,
                first_value(v.raw) over (partition by v.request_id, m.key, v.folded
                   order by length(v.raw), v.raw) as best_raw
              from vote v join member m on m.request_id = v.request_id and m.product_key = v.product_key
              window f as (partition by v.request_id, m.key, v.folded)))
          group by request_id, key)""",
    ),
    "listed": (
        ("dim",),
        """select request_id, key, upc, description, match_name, purchases, first_seen, last_seen,
          case when purchases >= 12 then 5 when purchases >= 7 then 4 when purchases >= 4 then 3
               when purchases >= 2 then 2 else 1 end as tier,
          purchases >= 2 and last_seen < stale_before as stopped,
          count(*) over (partition by request_id, description) > 1 as shares_name
        from (select *, case when count(*) over (partition by request_id, label) > 1
                   then match_name else label end as description
              from (select *, concat('', cast(max(last_seen) over (partition by request_id) as date)
                       - interval 180 day)[1:10] as stale_before from dim)
              where not refused)""",
    ),
    "point": (
        ("purchase",),
        f"""select *, coalesce(unit_retail, unit_paid) as unit_amount from (
          select *, {over('retail_amt', 'cnt')} as unit_retail, {over('paid_amt', 'cnt')} as unit_paid from (
            select p.*, coalesce(loyalty_amt, retail_amt) as paid_amt,
              case when not k.measures and quantity >= 2 then cast(quantity as bigint) end as cnt
            from purchase p join (select request_id, coalesce(bool_or(quantity <> round(quantity)), false) as measures
                                  from txn_item group by 1) k on k.request_id = p.request_id))""",
    ),
    "series": (
        ("point", "member"),
        """select p.*, m.key, row_number() over (partition by p.request_id, m.key
             order by on_date, length(p.product_key), p.product_key, occurred_at, item_id) as pos
        from point p join member m on m.request_id = p.request_id and m.product_key = p.product_key""",
    ),
    "amount": (
        ("series",),
        """select request_id, key, cast(unit_amount as double) as a, count(*) as n, sum(unit_amount) as total
        from series group by 1, 2, 3""",
    ),
    "anchor": (
        ("amount",),
        """with recursive walk as (
            select request_id, key, min(a) as c from amount group by 1, 2
            union all
            select m.request_id, m.key, min(m.a) from walk w join amount m
              on m.request_id = w.request_id and m.key = w.key
             and m.a > w.c and abs(m.a - w.c) / w.c > cast(0.03 as double)
            group by m.request_id, m.key, w.c)
          select * from walk""",
    ),
    "cluster": (
        ("anchor", "amount"),
        """select request_id, key, c, sum(n) as n, sum(total) as total from (
            select m.*, (select max(c) from anchor x where x.request_id = m.request_id and x.key = m.key
                         and x.c <= m.a) as c from amount m) group by 1, 2, 3""",
    ),
    "based": (
        ("cluster", "series", "amount"),
        f"""select request_id, key, biggest, low, high, points, coalesce(unit, common) as base from (
          select *, (select cast(round(min(a), 2) as double) from amount m where m.request_id = b.request_id
             and m.key = b.key and m.a < common and ({near('(common / m.a)')}) is not null) as unit
          from (
            select request_id, key, arg_min(n, place) as biggest,
              cast(arg_min(cast((2 * cast(total * 10000 as hugeint) + 100 * n) // (200 * n) as double), place)
                   / cast(100 as double) as double) as common,
              any_value(low) as low, any_value(high) as high, any_value(points) as points
            from (select c.*, row_number() over (partition by c.request_id, c.key
                     order by n desc, abs(c - mid), c) as place, low, high, points
                  from cluster c join (select request_id, key,
                      quantile_cont(cast(unit_amount as double), 0.5) as mid,
                      min(unit_amount) as low, max(unit_amount) as high, count(*) as points
                    from series group by 1, 2) s on s.request_id = c.request_id and s.key = c.key)
            group by 1, 2) b)""",
    ),
    "multiple": (
        ("based", "amount"),
        f"""select request_id, key, a, case when not exists (select 1 from amount g
              where g.request_id = x.request_id and g.key = x.key
                and g.a > base * (1 + cast(0.15 as double)) and g.a < base * (near - cast(0.15 as double)))
            then near end as multiple_of
          from (select m.request_id, m.key, m.a, b.base, {near('(m.a / b.base)')} as near
                from amount m join based b on b.request_id = m.request_id and b.key = m.key) x""",
    ),
    "marked": (
        ("series", "multiple"),
        """select s.*, m.multiple_of from series s join multiple m on m.request_id = s.request_id
          and m.key = s.key and m.a = cast(s.unit_amount as double)""",
    ),
    "trend": (
        ("series",),
        """select request_id, key, count(*) filter (d > 0) as ups, count(*) filter (d < 0) as downs,
            count(*) filter (d <> 0) >= 3 and cast(greatest(count(*) filter (d > 0), count(*) filter (d < 0)) as double)
              / count(*) filter (d <> 0) >= 0.75 as trending
          from (select request_id, key, unit_amount - lag(unit_amount) over
                  (partition by request_id, key order by pos) as d from series)
          group by 1, 2""",
    ),
    "shape": (
        ("based", "marked", "trend"),
        """select b.*, t.trending, m.multiples, case when m.multiples > 0 then 'multiple'
            when cast(b.biggest as double) / b.points <= 0.25 and b.points >= 4
             and cast(b.high as double) / cast(b.low as double) > cast(1.8 as double) and not t.trending
            then 'weight' else 'unit' end as shape,
            first_single, last_single, singles
          from based b join trend t on t.request_id = b.request_id and t.key = b.key
          join (select request_id, key, count(multiple_of) as multiples,
                  count(*) filter (multiple_of is null) as singles,
                  coalesce(arg_min(unit_paid, pos) filter (multiple_of is null), arg_min(unit_paid, pos)) as first_single,
                  coalesce(arg_max(unit_paid, pos) filter (multiple_of is null), arg_max(unit_paid, pos)) as last_single
                from marked group by 1, 2) m on m.request_id = b.request_id and m.key = b.key""",
    ),
}
