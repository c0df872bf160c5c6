"""The registered queries in plain SQL, for the comparison with DuckDB."""

from __future__ import annotations

from chargeaudit.functions.patterns import PROFILES, Pattern
from chargeaudit.plans.tables import FAMILY_NAMES, GIVEN_NAMES, STREETS, TEXT_BAR, TEXT_MARGIN, UNCODED_BAR


def _trim(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {value})"


def _rounded(value: str, digits: int) -> str:
    return f"cast({_fixed(value, digits)} as double)"


def _ratio4(value: str) -> str:
    return f"floor(({value}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def _lettered(number: str) -> str:
    """Four base-36 signs from A000 on."""
    signs = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = f"(({number}) + {10 * 36**3})"
    return " || ".join(f"substr('{signs}', cast({value} // {36**n} % 36 as bigint) + 1, 1)" for n in (3, 2, 1, 0))


def _letter_code(letter: str, key: str) -> str:
    return (
        f"(case when {key} < 10000 then '{letter}' || lpad(cast({key} as varchar), 4, '0') "
        f"when {key} < {10_000 + 26 * 36**3} then '{letter}' || {_lettered(f'{key} - 10000')} "
        "else error('key beyond the range of its codes') end)"
    )


def _part_code(key: str) -> str:
    rest, size = f"({key} - 100000)", 26 * 36**3
    return (
        f"(case when {key} < 100000 then lpad(cast({key} as varchar), 5, '0') "
        f"when {key} < {100_000 + 10 * size} then cast({rest} // {size} as varchar) || {_lettered(f'{rest} % {size}')} "
        "else error('key beyond the range of its codes') end)"
    )


PART_CODE = _part_code("p_partkey")
DESCRIPTION = "concat_ws(' ', p_name, lower(p_type), 'size', cast(p_size as varchar))"

CODES = rf"""
raw_codes as (
  select '  ' || {PART_CODE} || chr(9) as hcpc, {DESCRIPTION} as long_description,
         ' ' || p_name as short_description, 1 as file_no, p_partkey as row_no from part
  union all
  select {PART_CODE}, 'outdated', p_brand, 2, p_partkey from part
  union all
  select lower({_letter_code("J", "s_suppkey")}), null, s_name, 1, s_suppkey from supplier
  union all
  select n_name, '', null, 3, n_nationkey from nation
),
codes as (
  select code, long_description, short_description from (
    select *, row_number() over (partition by code order by file_no, row_no) as rn from (
      select upper({_trim('hcpc')}) as code, nullif({_trim('long_description')}, '') as long_description,
             nullif({_trim('short_description')}, '') as short_description, file_no, row_no
      from raw_codes)
    where regexp_full_match(code, '[A-Z0-9]{{5}}'))
  where rn = 1
)"""

RATES = rf"""
raw_rates as (
  select {PART_CODE} || ' ' as hcpcs,
         cast(p_retailprice / 32.74::DOUBLE * 0.5::DOUBLE as varchar) as work_rvu,
         case when p_size > 45 then 'NA' else cast(p_retailprice / 32.74::DOUBLE * 0.3::DOUBLE as varchar) end as fac_pe_rvu,
         case when p_size < 5 then null else cast(p_retailprice / 32.74::DOUBLE * 0.2::DOUBLE as varchar) end as mp_rvu,
         p_partkey as row_no from part
  union all
  select 'r000' || cast(r_regionkey as varchar), '1.25', '0.5', r_name, r_regionkey from region
),
rates as (
  select code, work_rvu, pe_rvu, mp_rvu, total_rvu,
         round_even(total_rvu * 32.74::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE as medicare_reference_price
  from (
    select *, work_rvu + pe_rvu + mp_rvu as total_rvu,
           row_number() over (partition by code order by row_no) as rn
    from (
      select upper({_trim('hcpcs')}) as code, coalesce(try_cast(work_rvu as double), 0) as work_rvu,
             coalesce(try_cast(fac_pe_rvu as double), 0) as pe_rvu,
             coalesce(try_cast(mp_rvu as double), 0) as mp_rvu, row_no
      from raw_rates)
    where regexp_full_match(code, '[A-Z0-9]{{5}}'))
  where rn = 1
)"""

CATALOG = f"""{CODES},{RATES},
catalog as (
  select code, long_description, short_description, total_rvu, medicare_reference_price,
         total_rvu > 0 as has_price_data,
         case when long_description = '' then code else code || ': ' || long_description end as document
  from (
    select coalesce(c.code, r.code) as code,
           coalesce(c.long_description, c.short_description, '') as long_description,
           coalesce(c.short_description, '') as short_description,
           coalesce(r.total_rvu, 0) as total_rvu,
           coalesce(r.medicare_reference_price, 0) as medicare_reference_price
    from codes c full join rates r on c.code = r.code)
)"""

LINE_NO = "cast(l_linenumber as bigint) * 10000000000000000 + l_partkey * 10000000 + l_suppkey"
CHARGE_CODE = f"""case when l_discount >= 0.1::DOUBLE then null
       when l_tax >= 0.08::DOUBLE then {_letter_code("X", "l_partkey")}
       when l_returnflag = 'R' then {_letter_code("J", "l_suppkey")}
       else {_part_code("l_partkey")} end"""

LINES = f"""
lines as (
  select l_orderkey as bill_id, {LINE_NO} as line_no, {CHARGE_CODE} as code, {DESCRIPTION} as description,
         cast(l_quantity as bigint) as quantity,
         case when l_quantity > 1 then l_extendedprice end as billed_amount,
         strftime(l_shipdate, '%m/%d/%Y') as service_date
  from lineitem join part on l_partkey = p_partkey
)"""

PAIRS = f"""
pairs as (
  select {_part_code("p_partkey")} as code,
         {_part_code("p_partkey + 1")} as component_code from part
)"""

LINE_COLUMNS = "l.bill_id, l.line_no, l.code, l.description, l.quantity, l.billed_amount, l.service_date"
TIERS = "case when {r} > 3 then 'high' when {r} >= 1.5 then 'medium' when {r} >= 1.2 then 'low' end"


def _priced(name: str, per_unit: bool) -> str:
    billed = "l.billed_amount / l.quantity" if per_unit else "l.billed_amount"
    return f"""
{name} as (
  select * from (
    select l.*, c.medicare_reference_price, {billed} / c.medicare_reference_price as overcharge_ratio
    from lines l join catalog c on l.code = c.code where c.has_price_data)
  where overcharge_ratio >= 1.2
)"""


UNKNOWN = """
unknown as (
  select l.* from lines l where l.code is not null and not exists (select 1 from catalog c where c.code = l.code)
)"""


def _duplicates(source: str, keys: str) -> str:
    return f"""
ordered as (
  select *, strptime(service_date, '%m/%d/%Y')::date as day,
         lag(strptime(service_date, '%m/%d/%Y')::date) over (
           partition by {keys} order by strptime(service_date, '%m/%d/%Y')::date, bill_id, line_no) as previous
  from {source} where code is not null
),
duplicates as (
  select *, case when day = previous then 'high' else 'medium' end as severity,
         strftime(previous, '%m/%d/%Y') as related
  from ordered where datediff('day', previous, day) <= 1
)"""


UNBUNDLED = """
unbundled as (
  select l.*, (
    select min(p.code) from pairs p join lines o on o.code = p.code
    where o.bill_id = l.bill_id and p.component_code = l.code) as related
  from lines l
),
unbundled_lines as (select * from unbundled where related is not null)"""

SUMMARY_LINES = """
summary_lines as (
  select * from (select *, count(code) over (partition by bill_id) as n_coded from lines) where n_coded = 0
)"""

_BILLED = f"coalesce('$' || {_fixed('billed_amount', 2)}, 'an unreadable amount')"
EXPLAIN = f"""
case when anomaly_type = 'price_overcharge' then
       'Code ' || code || ' was billed at ' || {_BILLED} || ', which is ' || {_fixed('overcharge_ratio', 1)}
       || 'x the Medicare reference rate of $' || {_fixed('medicare_reference_price', 2)} || '.'
     when anomaly_type = 'duplicate_charge' then
       'Code ' || code || ' was billed for ' || {_BILLED} || ' on ' || service_date
       || ' and had already been billed on ' || related || '.'
     when anomaly_type = 'unbundling' then
       'Code ' || code || ' was billed separately for ' || {_BILLED} || ' although it is part of code '
       || related || ' on the same bill.'
     when related = 'summary bill' then
       'This line was billed for ' || {_BILLED} || ' on a summary bill without procedure codes.'
     else 'Code ' || code || ' was billed for ' || {_BILLED} || ' but is not in the code list.' end"""
ACTION = """
case when anomaly_type = 'duplicate_charge' then
       'Ask your provider why code ' || code || ' appears twice on dates ' || related || ' and ' || service_date || '.'
     when anomaly_type = 'unbundling' then
       'Contact your insurance company to confirm this code should not be bundled with ' || related || '.'
     when code is null then
       'Request a full itemized bill with procedure codes before disputing this charge.'
     else 'Request an itemized bill and ask your provider to explain the charge for code ' || code || '.' end"""

FINDINGS = f"""{CATALOG},{LINES},{PAIRS},{_priced('priced', True)},{UNKNOWN},
{_duplicates('lines', 'bill_id, code')},{UNBUNDLED},{SUMMARY_LINES},
raw_findings as (
  select {LINE_COLUMNS}, 'price_overcharge' as anomaly_type, {TIERS.format(r='overcharge_ratio')} as severity,
         medicare_reference_price, overcharge_ratio, null::varchar as related from priced l
  union all
  select {LINE_COLUMNS}, 'unknown_code', 'medium', null, null, null from unknown l
  union all
  select {LINE_COLUMNS}, 'duplicate_charge', severity, null, null, related from duplicates l
  union all
  select {LINE_COLUMNS}, 'unbundling', 'medium', null, null, related from unbundled_lines l
  union all
  select {LINE_COLUMNS}, 'unknown_code', 'info', null, null, 'summary bill' from summary_lines l
),
findings as (
  select *, case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end as severity_rank,
         case anomaly_type when 'price_overcharge' then 0 when 'duplicate_charge' then 1 when 'unbundling' then 2
           when 'upcoding' then 3 else 4 end as type_rank,
         {EXPLAIN} as explanation, {ACTION} as suggested_action
  from raw_findings
),
numbered as (
  select *, row_number() over (partition by bill_id order by severity_rank, line_no, type_rank) as anomaly_no
  from findings
)"""

SUMMARY = f"""
summary as (
  select b.bill_id, b.total_line_items, b.total_billed_amount, coalesce(f.n, 0) as anomaly_count,
         coalesce(f.h, 0) as high_severity_count, coalesce(f.m, 0) as medium_severity_count, f.potential_overcharge_total
  from (
    select bill_id, count(*) as total_line_items,
           {_rounded('case when count(*) = count(billed_amount) then sum(billed_amount) end', 2)} as total_billed_amount
    from lines group by bill_id) b
  left join (
    select bill_id, count(*) as n, count(case when severity = 'high' then 1 end) as h, count(case when severity = 'medium' then 1 end) as m,
           {_rounded("""sum(case when overcharge_ratio > 0 and billed_amount - billed_amount / overcharge_ratio > 0
             then billed_amount - billed_amount / overcharge_ratio end)""", 2)} as potential_overcharge_total
    from findings group by bill_id) f on b.bill_id = f.bill_id
)"""

DOMINANT = """
per_type as (
  select bill_id, anomaly_type, count(*) as n, min(anomaly_no) as first_no from numbered group by all
),
dominant as (
  select bill_id, anomaly_type as dominant_type, cast(total as bigint) as anomaly_count from (
    select *, sum(n) over (partition by bill_id) as total,
           row_number() over (partition by bill_id order by n desc, first_no) as rn from per_type)
  where rn = 1
),
subjects as (
  select *, case when anomaly_count = 1 then 'Dispute: ' || label || ' — Itemized Review Requested'
    else 'Dispute: ' || anomaly_count || ' Billing Issues (' || label || ' and Others) — Review Requested' end as subject_line
  from (select *, case dominant_type when 'price_overcharge' then 'Possible Overcharge'
    when 'duplicate_charge' then 'Duplicate Charge' when 'unbundling' then 'Unbundling Concern'
    when 'upcoding' then 'Upcoding Concern' else 'Unknown Charge Code' end as label from dominant)
)"""

BRIEFS = f"""
briefs as (
  select n.bill_id, (anomaly_no - 1) // 500 + 1 as part_no,
    string_agg(
      '### Anomaly ' || anomaly_no || ': ' || upper(anomaly_type) || ' — ' || upper(severity) || ' severity' || chr(10)
      || 'Service: ' || description || coalesce(' (code: ' || code || ')', '') || chr(10)
      || 'Billed: ' || coalesce('$' || {_fixed('billed_amount', 2)}, 'unknown amount') || chr(10)
      || coalesce('Medicare reference price: $' || {_fixed('medicare_reference_price', 2)} || chr(10), '')
      || coalesce('Overcharge ratio: ' || {_fixed('overcharge_ratio', 1)} || 'x Medicare rate' || chr(10), '')
      || 'Service date: ' || service_date || chr(10)
      || 'Explanation: ' || explanation || chr(10)
      || 'Suggested action: ' || suggested_action || chr(10), chr(10) order by anomaly_no) as entries
  from numbered n group by all
),
whole_briefs as (
  select b.bill_id, b.part_no, case when b.part_no = 1 then
      '## Bill Analysis Summary' || chr(10) || chr(10)
      || 'Total line items analysed: ' || total_line_items || chr(10)
      || 'Anomalies found: ' || anomaly_count || chr(10)
      || 'High severity: ' || high_severity_count || chr(10)
      || 'Medium severity: ' || medium_severity_count || chr(10)
      || coalesce('Estimated potential overcharge: $' || {_fixed('potential_overcharge_total', 2)} || chr(10), '')
      || chr(10) || '## Anomalies to Address in the Letter' || chr(10) || chr(10)
    else '' end || entries as brief
  from briefs b join summary s on b.bill_id = s.bill_id
)"""

LETTERS = """
letter_parts as (
  select bill_id, (anomaly_no - 1) // 500 + 1 as part_no,
    coalesce(string_agg(case when severity in ('high', 'medium') then explanation || ' ' || suggested_action end,
      chr(10) || chr(10) order by anomaly_no), '') as majors,
    coalesce(string_agg(case when severity not in ('high', 'medium') then description || ': ' || explanation end,
      ' ' order by anomaly_no), '') as minors
  from numbered group by all
),
letters as (
  select p.bill_id, p.part_no, s.subject_line,
    case when p.part_no = 1 then 'Dear Billing Department,' || chr(10) || chr(10)
      || 'I am writing to ask for a review of my bill. I found ' || s.anomaly_count
      || ' charge(s) that I would like you to explain or correct.'
    else 'This is part ' || p.part_no || ' of my letter and continues the list of charges.' end
    || case when majors <> '' then chr(10) || chr(10) || majors else '' end
    || case when minors <> '' then chr(10) || chr(10) || 'Please also look at these smaller points. ' || minors else '' end
    || chr(10) || chr(10) || 'Please review these charges, send me an itemized bill, and reply in writing within 30 days. '
    || 'Thank you for your help.' as body
  from letter_parts p join subjects s on p.bill_id = s.bill_id
)"""

TEXTS = """
texts as (
  select 'documents' as source, doc_id as text_id, 0::bigint as turn, text from documents
  union all select 'pages', page_id, 0, html from pages
  union all select 'conversations', conv_id, turn, text from conversations
)"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The SQL engine's patterns have no look-aheads: the strict numbers as ranges of digits.
STRICT_SSN_RANGES = (
    r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d{2}|6[0-57-9]\d|66[0-57-9])[-\s]?(?:0[1-9]|[1-9]\d)[-\s]?"
    r"(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
)


def _sql_regex(pattern: Pattern) -> str:
    regex = STRICT_SSN_RANGES if "(?!" in pattern.regex else pattern.regex
    return _sql_text(("(?i)" if pattern.ignore_case else "") + regex)


def _redaction(profile: str) -> str:
    """One common table expression per pattern: count, then replace."""
    steps = []
    previous = "texts"
    columns = "source, text_id, turn"
    start = "text as t0"
    for number, pattern in enumerate(PROFILES[profile]):
        regex = _sql_regex(pattern)
        token = _sql_text(pattern.token.replace("$1", "\\1"))
        carried = "".join(f", n{i}" for i in range(number))
        source = f"(select {columns}, {start} from {previous})" if number == 0 else previous
        steps.append(
            f"step{number} as (select {columns}{carried}, len(regexp_extract_all(t0, {regex})) as n{number}, "
            f"regexp_replace(t0, {regex}, {token}, 'g') as t0 from {source})"
        )
        previous = f"step{number}"
    return ",\n".join(steps) + f",\nredacted as (select *, {_total(profile)} as n_total from {previous})"


def _total(profile: str) -> str:
    return " + ".join(f"n{i}" for i in range(len(PROFILES[profile])))


def _label_rows(profile: str) -> str:
    by_label: dict[str, list[str]] = {}
    for number, pattern in enumerate(PROFILES[profile]):
        by_label.setdefault(pattern.label, []).append(f"n{number}")
    rows = [
        f"select '{label}' as label, cast(sum({' + '.join(names)}) as bigint) as n_matches, "
        f"count(case when {' + '.join(names)} > 0 then 1 end) as n_texts from redacted"
        for label, names in by_label.items()
    ]
    return " union all ".join(rows)


def _any_match(text: str, profile: str, first: int | None = None) -> str:
    patterns = PROFILES[profile][:first]
    return " or ".join(
        f"regexp_matches({text}, {_sql_regex(p)})" for p in patterns
    )


CODE_REGEX = r"'(?i)\b([A-Z]\d{4}|\d{5})\b'"
LINE_TEXT = (
    "concat_ws(' ', service_date, lower(code), description, "
    "coalesce('$' || cast(cast(billed_amount as decimal(12,2)) as varchar), 'n/a'))"
)

BILL_TEXTS = f"""
line_rows as (
  select *, row_number() over (partition by bill_id order by line_no) as no, {LINE_TEXT} as line_text from lines
),
bill_texts as (
  select bill_id, (no - 1) // 500 + 1 as part_no, string_agg(line_text, chr(10) order by no) as redacted_text
  from line_rows group by all
),
text_codes as (
  select bill_id, part_no, code, min(pos) as first_at from (
    select bill_id, part_no, upper(unnest(hits)) as code, unnest(range(1, len(hits) + 1)) as pos
    from (select *, regexp_extract_all(redacted_text, {CODE_REGEX}, 1) as hits from bill_texts))
  group by all
),
positions as (
  select bill_id, part_no, code, row_number() over (partition by bill_id, part_no order by first_at) as position from text_codes
)"""

VECTOR_CATALOG = f"""
code_keys as (
  select {PART_CODE} as code, p_partkey as key from part
  union all select {_letter_code("J", "s_suppkey")}, s_suppkey from supplier
),
vector_catalog as (
  select c.*, e.embedding::DOUBLE[] as embedding
  from catalog c join code_keys k on c.code = k.code
  join embeddings e on e.vec_id = k.key % (select count(*) from embeddings)
)"""

VECTORS = f"""{CATALOG},{VECTOR_CATALOG},
texts_used as (select vec_id as text_id, embedding::DOUBLE[] as embedding from embeddings
  where vec_id in (select l_suppkey from lineitem)),
scored as (
  select text_id, code, medicare_reference_price as price,
         round(list_cosine_similarity(t.embedding, v.embedding), 9) as similarity
  from texts_used t cross join vector_catalog v where v.has_price_data
),
ranked as (
  select *, row_number() over (partition by text_id order by similarity desc, code) as rank from scored
)"""

WORD_VECTORS = r"""
doc_words as (
  select code, word, count(*) as tf from (select code, unnest(regexp_extract_all(lower(document), '[\p{L}\p{N}]+')) as word from catalog)
  group by all),
idf as (select word, ln(1.0::DOUBLE + n / count(*)) as idf from doc_words, (select count(*)::DOUBLE as n from catalog) group by word, n),
doc_vectors as (
  select code, word, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by code)) as weight from doc_words join idf using (word))"""


def _text_matches(asked: str, k: int) -> str:
    """Ranked codes of the distinct texts of a table with a column ``text``."""
    return rf"""
    text_words as (
      select text, word, count(*) as tf from (
        select text, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as word from (select distinct text from {asked}))
      group by all),
    text_vectors as (
      select text, word, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by text)) as weight from text_words join idf using (word)),
    text_pairs as (
      select text, code, round(sum(q.weight * d.weight), 9) as similarity
      from text_vectors q join doc_vectors d using (word) group by text, code),
    matches as (
      select text, code, round(similarity, 4) as similarity_score,
             row_number() over (partition by text order by similarity desc, code) as rank
      from text_pairs qualify rank <= {k})"""


RESOLVED = f"""{CATALOG},{VECTOR_CATALOG},
coded_lines as (
  select l_orderkey as bill_id, {LINE_NO} as line_no, {CHARGE_CODE} as code, l_suppkey as text_id from lineitem
),
wordings as (select vec_id as text_id, list_reverse(embedding::DOUBLE[]) as embedding from embeddings
  where vec_id in (select text_id from coded_lines)),
all_scored as (
  select text_id, code, round(list_cosine_similarity(t.embedding, v.embedding), 9) as similarity
  from wordings t cross join vector_catalog v
),
best as (
  select text_id, code, round(similarity, 4) as similarity_score from (
    select *, row_number() over (partition by text_id order by similarity desc, code) as rank from all_scored)
  where rank = 1
)"""

SQL: dict[str, str] = {
    "clean_codes": f"with {CODES} select * from codes",
    "compute_rates": f"with {RATES} select * from rates",
    "catalog_build": f"with {CATALOG} select * from catalog",
    "catalog_stats": f"""with {CATALOG}
        select count(*) as n_codes, count(case when medicare_reference_price > 0 then 1 end) as n_priced from catalog""",
    "catalog_readiness": f"""with {CATALOG}
        select case when count(*) > 0 then 'ok' else 'degraded' end as status, true as connected,
               count(*) as collection_size from catalog""",
    "load_report": f"""with {CATALOG}
        select 'codes' as dataset, count(*) as n_rows from codes
        union all select 'rates', count(*) from rates union all select 'catalog', count(*) from catalog""",
    "catalog_upsert": f"""with {CATALOG},
        new as (
          select code, short_description, medicare_reference_price from (
            select {_letter_code("J", "s_suppkey")} as code, s_name as short_description,
                   s_acctbal as medicare_reference_price,
                   row_number() over (partition by s_suppkey order by s_suppkey) as rn
            from supplier) where rn = 1
          union all
          select code, short_description, medicare_reference_price from (
            select {_letter_code("C", "c_custkey")} as code, c_name as short_description,
                   c_acctbal as medicare_reference_price,
                   row_number() over (partition by c_custkey order by c_custkey) as rn
            from customer) where rn = 1)
        select * from new union all
        select code, short_description, medicare_reference_price from catalog
        where code not in (select code from new)""",
    "stored_documents": f"""with {CATALOG}
        select code, case when instr(document, ': ') > 0 then substr(document, instr(document, ': ') + 2) else '' end
                 as long_description, short_description, medicare_reference_price, total_rvu, has_price_data from catalog""",
    "exact_lookup": f"""with {CATALOG},{LINES}
        select bill_id, line_no, l.code, c.code is not null as found, c.long_description, c.medicare_reference_price,
               c.has_price_data
        from lines l left join catalog c on l.code = c.code""",
    "unknown_codes": f"""with {CATALOG},{LINES}
        select distinct bill_id, code from lines where code is not null and code not in (select code from catalog)""",
    "lookup_coverage": f"""with {CATALOG},{LINES}
        select bill_id, count(*) as n_codes, count(hit) as n_found, count(*) - count(hit) as n_unknown
        from (select distinct l.bill_id, l.code, c.code as hit from lines l left join catalog c on l.code = c.code
              where l.code is not null) group by bill_id""",
    "overcharge_summary": f"""with {CATALOG},{LINES},{_priced('priced', True)}
        select bill_id, count(*) as anomaly_count, count(case when overcharge_ratio > 3 then 1 end) as high_severity_count,
               count(case when overcharge_ratio >= 1.5 and overcharge_ratio <= 3 then 1 end) as medium_severity_count,
               {_rounded('sum(billed_amount - billed_amount / overcharge_ratio)', 2)} as potential_overcharge_total
        from priced group by bill_id""",
    "price_overcharge": f"""with {CATALOG},{LINES},{_priced('priced', True)}
        select bill_id, line_no, code, severity, medicare_reference_price, overcharge_ratio from (
          select *, {TIERS.format(r='overcharge_ratio')} as severity from priced) p
        """.replace("medicare_reference_price, overcharge_ratio from (", "medicare_reference_price, "
                    + _ratio4("overcharge_ratio") + " as overcharge_ratio from ("),
    "price_overcharge_line": f"""with {CATALOG},{LINES},{_priced('priced', False)}
        select bill_id, line_no, code, {TIERS.format(r='p.overcharge_ratio')} as severity, medicare_reference_price,
               {_ratio4('p.overcharge_ratio')} as overcharge_ratio from priced p""",
    "unknown_code_lines": f"""with {CATALOG},{LINES},{UNKNOWN}
        select bill_id, line_no, code, 'unknown_code' as anomaly_type, 'medium' as severity from unknown""",
    "duplicate_charge": f"""with patient_lines as (
          select o_custkey as patient_id, l_orderkey as bill_id, {LINE_NO} as line_no,
                 replace(p_brand, 'Brand#', 'B') as code, strftime(l_shipdate, '%m/%d/%Y') as service_date
          from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
        {_duplicates('patient_lines', 'patient_id, code')}
        select bill_id, line_no, code, service_date, severity, related from duplicates""",
    "neighbour_days": f"""with patient_lines as (
          select o_custkey as patient_id, replace(p_brand, 'Brand#', 'B') as code, l_shipdate::date as service_day
          from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
        days as (select patient_id, code, service_day, count(*) as n_lines from patient_lines group by all),
        near as (select *, lag(service_day) over w as previous_day, lead(service_day) over w as next_day
                 from days window w as (partition by patient_id, code order by service_day))
        select patient_id, code, strftime(service_day, '%Y-%m-%d') as service_day, n_lines,
               strftime(previous_day, '%Y-%m-%d') as previous_day, strftime(next_day, '%Y-%m-%d') as next_day from near""",
    "unbundled_pairs": f"""with {LINES},{PAIRS}
        select distinct a.bill_id, p.code, p.component_code from lines a join pairs p on a.code = p.code
        join lines b on b.bill_id = a.bill_id and b.code = p.component_code""",
    "unbundled_lines": f"""with {LINES},{PAIRS},{UNBUNDLED}
        select bill_id, line_no, code, related from unbundled_lines""",
    "summary_bill_info": f"""with {LINES},{SUMMARY_LINES}
        select bill_id, line_no, 'unknown_code' as anomaly_type, 'info' as severity from summary_lines""",
    "detect_anomalies": f"""with {FINDINGS}
        select bill_id, anomaly_no, line_no, code, description, quantity, billed_amount, service_date, anomaly_type,
               severity, medicare_reference_price, {_ratio4('overcharge_ratio')} as overcharge_ratio, related,
               explanation, suggested_action from numbered""",
    "bill_summary": f"with {FINDINGS},{SUMMARY} select * from summary",
    "dominant_type": f"with {FINDINGS},{DOMINANT} select * from dominant",
    "subject_line": f"with {FINDINGS},{DOMINANT} select bill_id, subject_line from subjects",
    "anomaly_codes": f"""with {FINDINGS}
        select bill_id, code, row_number() over (partition by bill_id order by first_no) as position
        from (select bill_id, code, min(anomaly_no) as first_no from numbered where code is not null group by all)""",
    "anomaly_labels": f"""with {FINDINGS}
        select bill_id, anomaly_no,
          case anomaly_type when 'price_overcharge' then 'Price Overcharge' when 'duplicate_charge' then 'Duplicate Charge'
            when 'unbundling' then 'Unbundling' when 'upcoding' then 'Upcoding' else 'Unknown Code' end as type_label,
          upper(severity[1]) || severity[2:] as severity_label,
          coalesce('$' || format('{{:,.2f}}', billed_amount), 'N/A') as billed_text,
          case when overcharge_ratio > 1 then {_fixed('overcharge_ratio', 1)} || '× Medicare rate' end as ratio_text
        from numbered""",
    "findings_brief": f"""with {FINDINGS},{SUMMARY},{BRIEFS}
        select bill_id, part_no, length(brief) as n_chars, md5(brief) as brief_md5 from whole_briefs""",
    "letter_body": f"""with {FINDINGS},{DOMINANT},{LETTERS}
        select bill_id, part_no, subject_line, length(body) as n_chars, md5(body) as body_md5 from letters""",
    "letter_citations": rf"""with {FINDINGS},{DOMINANT},{LETTERS},
        cited as (select distinct bill_id, (anomaly_no - 1) // 500 + 1 as part_no, code from numbered where code is not null)
        select c.bill_id, c.part_no, c.code,
               cast(len(regexp_extract_all(body, '\b' || c.code || '\b')) as bigint) as n_citations,
               case when regexp_matches(body, '\b' || c.code || '\b')
                 then length(regexp_extract(body, '(?s)^(.*?)\b' || c.code || '\b', 1)) + 1 else 0 end as first_at
        from cited c join letters l on c.bill_id = l.bill_id and c.part_no = l.part_no""",
    "redact_text": f"""with {TEXTS},{_redaction('parity')}
        select source, text_id, turn, cast(n_total as bigint) as n_total, length(t0) as n_chars, md5(t0) as text_md5 from redacted""",
    "redact_text_strict": f"""with {TEXTS},{_redaction('strict')}
        select source, text_id, turn, cast(n_total as bigint) as n_total,
               length(case when trim(t0, chr(32) || chr(9) || chr(10) || chr(13)) = '' then '' else t0 end) as n_chars,
               md5(case when trim(t0, chr(32) || chr(9) || chr(10) || chr(13)) = '' then '' else t0 end) as text_md5 from redacted""",
    "redact_audit": f"with {TEXTS},{_redaction('parity')} {_label_rows('parity')}",
    "leak_gate": f"""with {TEXTS},{_redaction('parity')}
        select t.source, t.text_id, t.turn, not ({_any_match('t.text', 'parity')}) as raw_is_safe,
               not ({_any_match('r.t0', 'parity')}) as redacted_is_safe
        from texts t join redacted r on t.source = r.source and t.text_id = r.text_id and t.turn = r.turn""",
    "candidate_codes": f"""with {LINES},
        hits as (select *, regexp_extract_all({LINE_TEXT}, {CODE_REGEX}, 1) as hits from lines),
        found as (select bill_id, line_no, upper(unnest(hits)) as code, unnest(range(1, len(hits) + 1)) as pos from hits),
        first as (select bill_id, code, min((line_no, pos)) as first_at from found group by all)
        select bill_id, code, position from (
          select *, row_number() over (partition by bill_id order by first_at) as position from first)""",
    "review_context": f"""with {CATALOG},{LINES},{BILL_TEXTS},
        tables as (
          select bill_id, part_no, count(*) as n_codes, string_agg('| ' || p.code || ' | ' || short_description[1:50] || ' | '
            || case when has_price_data then '$' || {_fixed('medicare_reference_price', 2)} else 'N/A' end || ' | '
            || case when has_price_data then 'Yes' else 'No' end || ' |', chr(10) order by position) as rows
          from positions p join catalog c on p.code = c.code group by all),
        contexts as (
          select b.bill_id, b.part_no, coalesce(n_codes, 0) as n_codes,
            '## Redacted Medical Bill' || chr(10) || chr(10) || 'File: order-' || b.bill_id || '.pdf  |  Type: pdf'
            || chr(10) || chr(10) || '```' || chr(10) || redacted_text || chr(10) || '```' || chr(10) || chr(10)
            || '## Catalog records' || chr(10) || chr(10)
            || coalesce('The following codes were found in the bill text and looked up in the catalog. '
              || 'These records are exact; they need no search.' || chr(10) || chr(10)
              || '| Code | Short Description | Medicare Ref Price | Has Price Data |' || chr(10)
              || '|------|------------------|--------------------|----------------|' || chr(10) || rows,
              'No codes were found in the bill text. '
              || 'Search the catalog by description for what the text mentions.')
            || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Please judge the charges of this bill. '
            || 'Give every finding as one record with its line, kind and severity.' as context
          from bill_texts b left join tables t on b.bill_id = t.bill_id and b.part_no = t.part_no)
        select bill_id, part_no, n_codes, length(context) as n_chars, md5(context) as context_md5 from contexts""",
    "assemble_pages": rf"""with pages_in as (
          select conv_id as bill_id, turn + 1 as page_no, nullif({_trim('text')}, '') as body from conversations)
        select bill_id, 1::bigint as part_no, count(body) as n_pages,
               md5(string_agg('[Page ' || page_no || ']' || chr(10) || body, chr(10) || chr(10) order by page_no)) as text_md5,
               case when count(body) = 0 then 'ocr_failed' else 'ok' end as status
        from pages_in group by bill_id""",
    "short_text_filter": f"""with {TEXTS}
        select source, text_id, turn, coalesce(length({_trim('text')}), 0) as meaningful_chars,
               case when coalesce(length({_trim('text')}), 0) < 50 then 'bill_too_short' else 'ok' end as text_status
        from texts""",
    "knn_search": f"""with pairs as (
          select q.vec_id as query_id, {_part_code("c.vec_id")} as code,
                 round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) as similarity
          from embeddings q cross join embeddings c),
        ranked as (select *, row_number() over (partition by query_id order by similarity desc, code) as rank from pairs)
        select query_id, code, round(similarity, 4) as similarity_score, rank from ranked where rank <= 5""",
    "upcoding": f"""with {VECTORS},
        billed as (
          select l_orderkey as bill_id, {LINE_NO} as line_no, {_part_code("l_partkey")} as code, l_suppkey as text_id
          from lineitem),
        own as (
          select b.*, s.price, round(s.similarity, 4) as own_score from billed b join scored s on b.text_id = s.text_id and b.code = s.code),
        offers as (
          select o.code, o.text_id, o.price, r.code as other_code,
                 row_number() over (partition by o.code, o.text_id order by r.similarity desc, r.code) as rn
          from (select distinct code, text_id, price, own_score from own) o join ranked r on o.text_id = r.text_id and r.rank <= 5
          where r.price < o.price and round(round(r.similarity, 4) - o.own_score, 4) >= 0.05)
        select bill_id, line_no, b.code, 'upcoding' as anomaly_type, 'medium' as severity,
               price as medicare_reference_price, other_code as related
        from billed b join offers o on b.code = o.code and b.text_id = o.text_id where rn = 1""",
    "resolve_lines": f"""with {RESOLVED}
        select bill_id, line_no, coalesce(v.code, b.code) as matched_code,
               case when v.code is not null then 'exact' when b.code is not null then 'similar' else 'none' end as match_kind,
               case when v.code is null then b.similarity_score end as similarity_score
        from coded_lines l left join catalog v on l.code = v.code left join best b on b.text_id = l.text_id""",
    "uncoded_lines": f"""with {RESOLVED},
        flagged as (select *, count(code) over (partition by bill_id) as n_coded from coded_lines)
        select bill_id, line_no, 'unknown_code' as anomaly_type, 'info' as severity
        from flagged l left join best b on l.text_id = b.text_id
        where l.code is null and n_coded > 0 and coalesce(b.similarity_score, -1) < {UNCODED_BAR}""",
    "word_weights": f"with {CATALOG},{WORD_VECTORS} select code, word, round(weight, 6) as weight from doc_vectors",
    "description_match": f"""with {CATALOG},{WORD_VECTORS},
        asked as (select distinct {DESCRIPTION} as text from lineitem join part on l_partkey = p_partkey),
        {_text_matches('asked', 1)}
        select text as description, code, similarity_score from matches""",
    "search_text": f"""with {CATALOG},{WORD_VECTORS},
        asked as (
          select 'P' || p_partkey as query_key, case when p_size < 3 then ' ' || chr(9)
            else concat_ws(' ', lower(p_type), p_name, 'no.', cast(p_size as varchar)) end as text from part
          union all select 'C' || c_custkey, c_name from customer),
        {_text_matches('asked', 5)}
        select query_key, case when {_trim('a.text')} = '' then 'blank_query' when code is null then 'no_match' else 'ok' end as status,
               code, similarity_score, rank
        from asked a left join matches m on a.text = m.text""",
    "embed_text": f"with {CATALOG} select code, 256::bigint as n_dims, 1.0::DOUBLE as length from catalog",
    "search_result_text": f"""with {CATALOG},{VECTOR_CATALOG},
        known as (select * from vector_catalog),
        pairs as (
          select q.vec_id as query_id, k.*, round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding), 9) as similarity
          from embeddings q cross join known k),
        ranked as (select *, row_number() over (partition by query_id order by similarity desc, code) as rank from pairs),
        rows as (
          select query_id, count(*) as n_results, string_agg('| ' || code || ' | ' || short_description[1:50] || ' | '
            || case when has_price_data then '$' || {_fixed('medicare_reference_price', 2)} else 'N/A' end || ' | '
            || case when has_price_data then 'Yes' else 'No' end || ' | ' || {_fixed('round(similarity, 4)', 2)} || ' |',
            chr(10) order by rank) as body from ranked where rank <= 5 group by query_id)
        select query_id, n_results, md5('Search results for ''vector ' || query_id || ''' (' || n_results || ' found):' || chr(10) || chr(10)
          || '| Code | Short Description | Medicare Ref Price | Has Price Data | Similarity |' || chr(10)
          || '|------|------------------|--------------------|----------------|------------|' || chr(10) || body) as text_md5
        from rows""",
    "duplicate_windows": f"""with days as (
          select o_custkey as patient_id, replace(p_brand, 'Brand#', 'B') as code, l_shipdate::date as day
          from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
        windows as (select patient_id, code, day, (day - to_days(unnest([0, 1])))::date as start from days)
        select patient_id, code, strftime(start, '%Y-%m-%d') as window_start, count(*) as n_charges,
               strftime(min(day), '%Y-%m-%d') as first_day, strftime(max(day), '%Y-%m-%d') as last_day
        from windows group by patient_id, code, start having count(*) > 1""",
    "throttle_audit": """select user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as window_start,
               count(*) as n_events, count(*) - 5 as n_over
        from events group by all having count(*) > 5""",
    "record_violations": """with records as (
          select l_orderkey as bill_id, l_linenumber as line_no, l_partkey, l_suppkey,
                 cast(l_quantity as bigint) - 2 as quantity, l_extendedprice - 5000 as billed_amount,
                 case when l_tax < 0.01::DOUBLE then null else l_returnflag end as description,
                 case l_returnflag when 'A' then 'high' when 'N' then 'low' else 'urgent' end as severity
          from lineitem),
        checked as (
          select *, concat_ws('; ', case when description is null then 'description is required' end,
              case when quantity < 1 then 'quantity must be at least 1' end,
              case when billed_amount < 0 then 'billed_amount must not be negative' end,
              case when severity = 'urgent' then 'severity must be one of: high, medium, low, info' end) as violations
          from records)
        select violations, count(*) as n_records from checked group by violations""",
    "parse_findings": """with reports as (
          select l_orderkey as bill_id, l_linenumber as line_no, l_partkey, l_suppkey,
            '{"total_line_items": ' || cast(l_quantity as bigint) || ', "anomalies": [{"code": '
            || case when l_returnflag = 'N' then '' else '"' end || (10000 + l_suppkey)
            || case when l_returnflag = 'N' then '' else '"' end
            || ', "description": "item ' || l_partkey || '", "quantity": ' || (cast(l_quantity as bigint) - 2)
            || ', "billed_amount": ' || case when l_tax < 0.02::DOUBLE then 'null' else cast(cast(floor(l_extendedprice) as bigint) as varchar) end
            || ', "anomaly_type": "unknown_code", "severity": "' || case when l_linestatus = 'F' then 'high' else 'urgent' end
            || '", "explanation": "e", "suggested_action": "a"}, {"description": "other '  || l_suppkey
            || '", "anomaly_type": "upcoding", "severity": "low", "explanation": "e"'
            || case when l_discount < 0.05::DOUBLE then ', "suggested_action": "a"' else '' end || '}'
            || case when l_shipdate < timestamp '1993-01-01' then '' else ']}' end as report
          from lineitem),
        items as (select bill_id, line_no, unnest(range(2)) as item_no, report from reports where json_valid(report)),
        item as (select bill_id, line_no, item_no, json_extract(report, '$.anomalies[' || item_no || ']') as j from items)
        select bill_id, cast(line_no as bigint) as line_no, item_no, json_extract_string(j, '$.code') as code, json_extract_string(j, '$.description') as description,
               coalesce(cast(json_extract(j, '$.quantity') as bigint), 1) as quantity,
               try_cast(json_extract_string(j, '$.billed_amount') as double) as billed_amount,
               json_extract_string(j, '$.severity') as severity
        from item
        where coalesce(json_type(j, '$.code'), 'VARCHAR') = 'VARCHAR' and coalesce(cast(json_extract(j, '$.quantity') as bigint), 1) >= 1
          and json_extract_string(j, '$.severity') in ('high', 'medium', 'low', 'info')
          and json_type(j, '$.suggested_action') = 'VARCHAR'""",
}
SQL["finding_stats"] = SQL["parse_findings"].split("items as (")[0] + """
        per_report as (
          select bill_id, line_no, json_valid(report) as ok, report from reports)
        select cast(sum(case when ok then cast(json_extract(report, '$.total_line_items') as bigint) else 0 end) as bigint) as total_line_items,
               cast(sum(case when ok then 2 else 0 end) as bigint) as n_reported,
               (select count(*) from (""" + SQL["parse_findings"] + """)) as n_valid,
               cast(sum(case when ok then 2 else 0 end) as bigint) - (select count(*) from (""" + SQL["parse_findings"] + """)) as n_skipped
        from per_report"""
SQL["stream_redact"] = f"""with texts as (select 'documents' as source, doc_id as text_id, 0 as turn, text from documents),
        {_redaction('parity')}
        select text_id as doc_id, cast(n_total as bigint) as n_total, length(t0) as n_chars, md5(t0) as text_md5 from redacted
        where not ({_any_match('t0', 'parity')})"""
SQL["stream_prices"] = SQL["price_overcharge"]
SQL["stream_throttle"] = SQL["throttle_audit"]
SQL["stream_duplicate_charge"] = SQL["duplicate_charge"]

SQL["all_findings"] = f"""with {CATALOG},{WORD_VECTORS},
        charged as (
          select l.* replace (l.l_partkey % 1000 + 1 as l_partkey), {DESCRIPTION} as description, o_custkey
          from lineitem l join part on l.l_partkey = p_partkey join orders on l.l_orderkey = o_orderkey),
        lines as (
          select o_custkey as bill_id, l_orderkey * 10 + l_linenumber as line_no, {CHARGE_CODE} as code, description,
                 cast(l_quantity as bigint) as quantity, case when l_quantity > 1 then l_extendedprice end as billed_amount,
                 strftime(date_trunc('month', l_shipdate), '%m/%d/%Y') as service_date
          from charged),
        {PAIRS},{_priced('priced', True)},{UNKNOWN},
        days as (
          select *, strptime(service_date, '%m/%d/%Y')::date as day from lines where code is not null),
        per_day as (select bill_id, code, day, min(line_no) as first_no from days group by all),
        near_day as (
          select *, lag(day) over (partition by bill_id, code order by day) as previous from per_day),
        duplicates as (
          select l.*, case when line_no > first_no then 'high' else 'medium' end as severity,
                 strftime(case when line_no > first_no then l.day else previous end, '%m/%d/%Y') as related
          from days l join near_day d on l.bill_id = d.bill_id and l.code = d.code and l.day = d.day
          where line_no > first_no or datediff('day', previous, l.day) <= 1),
        whole as (
          select bill_id, component_code, min(p.code) as related from (select distinct bill_id, code from lines) o
          join pairs p on o.code = p.code group by all),
        unbundled_lines as (
          select l.*, w.related from lines l join whole w on w.bill_id = l.bill_id and w.component_code = l.code),
        {SUMMARY_LINES},
        asked as (select distinct description as text from lines),
        {_text_matches('asked', 5)},
        charges as (
          select distinct l.code, l.description, c.medicare_reference_price as price
          from lines l join catalog c on c.code = l.code where c.has_price_data),
        own as (
          select a.code, a.description, a.price, coalesce(round(p.similarity, 4), 0) as own_score
          from charges a left join text_pairs p on p.text = a.description and p.code = a.code),
        fits as (
          select o.code, o.description, o.price, m.code as related
          from own o join matches m on m.text = o.description join catalog c on c.code = m.code
          where c.has_price_data and c.medicare_reference_price < o.price and round(m.similarity_score - o.own_score, 4) >= {TEXT_MARGIN}
          qualify row_number() over (partition by o.code, o.description order by m.rank) = 1),
        far as (
          select l.* from (select *, count(code) over (partition by bill_id) as n_coded from lines) l
          left join matches m on m.text = l.description and m.rank = 1
          where l.code is null and n_coded > 0 and coalesce(m.similarity_score, -1) < {TEXT_BAR})
        select {LINE_COLUMNS}, 'price_overcharge' as anomaly_type, {TIERS.format(r='overcharge_ratio')} as severity,
               medicare_reference_price, {_ratio4('overcharge_ratio')} as overcharge_ratio, null::varchar as related from priced l
        union all select {LINE_COLUMNS}, 'unknown_code', 'medium', null, null, null from unknown l
        union all select {LINE_COLUMNS}, 'duplicate_charge', severity, null, null, related from duplicates l
        union all select {LINE_COLUMNS}, 'unbundling', 'medium', null, null, related from unbundled_lines l
        union all select {LINE_COLUMNS}, 'unknown_code', 'info', null, null, 'summary bill' from summary_lines l
        union all select {LINE_COLUMNS}, 'upcoding', 'medium', f.price, null, f.related
          from lines l join fits f on f.code = l.code and f.description = l.description
        union all select l.bill_id, l.line_no, null, l.description, l.quantity, l.billed_amount, l.service_date,
          'unknown_code', 'info', null, null, null from far l"""
SQL["catalog_from_files"] = SQL["catalog_build"]


def _forms() -> str:
    def digits(factor: int, width: int) -> str:
        return f"lpad(cast((c_custkey * {factor} + 17) % {10**width} as varchar), {width}, '0')"

    def chosen(words: tuple[str, ...]) -> str:
        return f"[{', '.join(_sql_text(w) for w in words)}][c_custkey % {len(words)} + 1]"

    return f"""texts as (
      select 'forms' as source, c_custkey as text_id, 0::bigint as turn, concat_ws(chr(10),
        'Patient Name: ' || {chosen(GIVEN_NAMES)} || ' ' || {chosen(FAMILY_NAMES)},
        case when c_custkey % 2 = 0 then 'SSN: ' || {digits(7, 3)} || '-' || {digits(11, 2)} || '-' || {digits(13, 4)} end,
        case when c_custkey % 3 = 0 then 'id ' || {digits(19, 3)} || '-' || {digits(23, 2)} || '-' || {digits(29, 4)} end,
        case when c_custkey % 2 = 1 then 'Medicare ID: 1EG4-TE5-MK' || {digits(31, 2)} end,
        'Member ID: ZX' || {digits(37, 7)},
        case when c_custkey % 5 <> 0 then 'DOB: 0' || (c_custkey % 9 + 1) || '/1' || (c_custkey % 9) || '/19' || {digits(41, 2)} end,
        (c_custkey % 9000 + 10) || ' ' || {chosen(STREETS)} || ' Street, Apt ' || (c_custkey % 40),
        'Phone (' || {digits(43, 3)} || ') ' || {digits(47, 3)} || '-' || {digits(53, 4)},
        'Mail c' || c_custkey || '@clinic.example',
        case when c_custkey % 4 = 0
          then 'Card 4' || {digits(59, 3)} || ' ' || {digits(61, 4)} || ' ' || {digits(67, 4)} || ' ' || {digits(71, 4)} end,
        case when c_custkey % 7 = 0 then 'From 10.' || (c_custkey % 256) || '.0.1' end,
        case when c_custkey % 6 = 0 then 'Ref ' || {digits(73, 10)} end,
        'Balance due on 01/15/2025 for 99213') as text
      from customer)"""


SQL["form_texts"] = f"""with {_forms()},{_redaction('parity')}
        select text_id, cast(n_total as bigint) as n_total, length(t0) as n_chars, md5(t0) as text_md5 from redacted"""
SQL["form_audit"] = f"with {_forms()},{_redaction('parity')} {_label_rows('parity')}"
SQL["form_audit_strict"] = f"with {_forms()},{_redaction('strict')} {_label_rows('strict')}"
SQL["response_rows"] = f"""with {FINDINGS},{DOMINANT},{SUMMARY}
        select n.bill_id, (n.anomaly_no - 1) // 500 + 1 as part_no, n.anomaly_no, n.code, n.description, n.quantity, n.billed_amount,
               n.service_date, n.anomaly_type, n.severity, n.medicare_reference_price, {_ratio4('overcharge_ratio')} as overcharge_ratio,
               md5(n.explanation || n.suggested_action) as words_md5, s.subject_line, m.anomaly_count, m.total_billed_amount
        from numbered n join subjects s on s.bill_id = n.bill_id join summary m on m.bill_id = n.bill_id"""
SQL["response_checks"] = f"""with {FINDINGS},{SUMMARY},
        parts as (select bill_id, max(anomaly_no) as n from numbered group by bill_id)
        select '' as violations, cast(sum(greatest(1, (coalesce(n, 0) + 499) // 500)) as bigint) as n_documents
        from summary left join parts using (bill_id)"""

_UPLOADS = """uploads as (
      select * replace (case when text_id % 17 = 0 then ' ' || chr(10) when text_id % 19 = 0 then 'Mail x@y.example' else text end as text),
             case when text_id % 11 = 0 then 'gif' when text_id % 2 = 0 then 'image' else 'pdf' end as file_type from forms)"""


def _routed(source: str, statuses: str) -> str:
    leak, blank = _any_match("t0", "parity"), _trim("t0")
    return f"""select text_id as bill_id, file_type, cast(length(t0) as bigint) as char_count, cast(n_total as bigint) as n_redactions,
        case {statuses} when {_trim('text')} = '' then 'ocr_failed' when {leak} then 'pii_redaction_failed'
          when length({blank}) < 50 then 'bill_too_short' else 'ok' end as status,
        case when not ({leak}) then md5(t0) end as text_md5 from {source}"""


_FORMS_UP = f"{_forms().replace('texts as (', 'forms as (', 1)},{_UPLOADS}, texts as (select * from uploads)"
SQL["bill_routes"] = f"""with {_FORMS_UP},{_redaction('parity')},
        both_texts as (select r.*, u.file_type, u.text from redacted r join uploads u using (text_id))
        {_routed('both_texts', "when text_id % 13 = 0 then 'file_too_large' when file_type = 'gif' then 'invalid_file_type'")}"""
SQL["gated_bills"] = f"""with {_FORMS_UP},{_redaction('parity')},
        sent as (select text_id, file_type, case when text_id % 3 = 0 then u.text else r.t0 end as t0, 0 as n_total, u.text
                 from redacted r join uploads u using (text_id))
        select * exclude (file_type) from ({_routed('sent', "when file_type = 'gif' then 'invalid_file_type'")})"""
SQL["published_texts"] = f"""with {_forms().replace('texts as (', 'forms as (', 1)},
        texts as (select * from forms union all select 'documents', doc_id, 0, text from documents),{_redaction('parity')}
        select case when {_any_match('t0', 'parity')} then 'held' else 'published' end as sink, source, text_id,
               cast(n_total as bigint) as n_total, md5(t0) as text_md5 from redacted"""
SQL["first_codes"] = SQL["candidate_codes"] + " where position <= 3"
SQL["embedder_hook"] = f"""with {CATALOG} select code, {', '.join(
    f"cast(length(document) - length(replace(lower(document), '{v}', '')) as double) as n_{v}" for v in 'aeiou')} from catalog"""


def _violations(name: str, source: str, tests: list[tuple[str, str]]) -> str:
    messages = ", ".join(f"case when {bad} then {_sql_text(message)} end" for message, bad in tests)
    return f"""select '{name}' as record, violations, count(*) as n_records from (
        select concat_ws('; ', {messages}) as violations from ({source})) group by violations"""


_KINDS, _LEVELS = "price_overcharge, duplicate_charge, unbundling, upcoding, unknown_code", "high, medium, low, info"
SQL["typed_violations"] = " union all ".join([
    _violations("bill", """select case when o_custkey % 9 <> 0 then o_orderpriority end as r, o_orderstatus as f, o_custkey - 20 as n from orders""", [
        ("redacted_text is required", "r is null"), ("file_type must be one of: pdf, image", "f not in ('F', 'O')"),
        ("char_count must not be negative", "n < 0")]),
    _violations("record", """select case when c_custkey % 8 <> 0 then c_name end as c, c_acctbal as p, c_nationkey - 3 as t,
            (c_nationkey - 2) / 20.0::DOUBLE as s from customer""", [
        ("code is required", "c is null"), ("medicare_reference_price must not be negative", "p < 0"),
        ("total_rvu must not be negative", "t < 0"), ("similarity_score must lie between 0 and 1", "s < 0 or s > 1")]),
    _violations("finding", """select o_custkey as k, o_totalprice as p, o_orderpriority as d from orders""", [
        ("description is required", "d is null"), ("quantity must be at least 1", "k % 5 < 1"),
        ("billed_amount must not be negative", "p - 20000 < 0"), (f"anomaly_type must be one of: {_KINDS}", "k % 3 <> 0"),
        (f"severity must be one of: {_LEVELS}", "k % 4 <> 0"), ("explanation is required", "k % 7 = 0"),
        ("medicare_reference_price must not be negative", "p - 9000 < 0"), ("overcharge_ratio must not be negative", "k % 2 = 0")]),
    _violations("summary", """select count(*) - 9 as l, sum(o_totalprice) - 200000 as b, count(*) filter (o_orderstatus = 'F') - 3 as h
            from orders group by o_custkey""", [
        ("total_line_items must not be negative", "l < 0"), ("total_billed_amount must not be negative", "b < 0"),
        ("high_severity_count must not be negative", "h < 0")]),
])
SQL["stream_redact_sinks"] = f"""with {_forms()},{_redaction('parity')}
        select case when {_any_match('t0', 'strict', 3)} then 'held' else 'safe' end as sink,
               text_id, cast(n_total as bigint) as n_total from redacted"""
SQL["stream_redact_counts"] = f"with {_forms()},{_redaction('parity')} {_label_rows('parity')}"
