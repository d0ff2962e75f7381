"""DuckDB SQL of the recommendation queries, put together from named parts."""

from __future__ import annotations

import re

PARTS = {
    "clicks": "select user_id, cast(json_extract_string(props, '$.k') as bigint) as item, epoch_us(ts) // 1000 as t, event_id from events where user_id is not null and json_extract_string(props, '$.k') is not null",
    "arts": "select vec_id as item, cast(label as bigint) as cat, n_chars as words, epoch_us(o_orderdate) // 1000 as created from embeddings left join documents on doc_id = vec_id left join orders on o_orderkey = vec_id",
    "lasts": "select *, row_number() over (partition by user_id order by t desc, event_id desc) as back from clicks",
    "click": "select user_id, item, t, event_id from lasts where user_id % 5 = 0 or back > 1",
    "query": "select user_id, item as target from lasts where user_id % 5 <> 0 and back = 1 union all select distinct user_id, -1 from clicks where user_id % 5 = 0",
    "seq": "select *, row_number() over (partition by user_id order by t, event_id) - 1 as pos, row_number() over (partition by user_id order by t desc, event_id desc) - 1 as loc, count(*) over (partition by user_id) as n from click",
    "cnt": "select item, count(*) as c from click group by item",
    "cf_w": "select a.item as i, b.item as j, sum((case when b.pos > a.pos then 1e0 else 0.7e0 end) * power(0.9e0, abs(b.pos - a.pos) - 1) / ln(1e0 + a.n)) as w from seq a join seq b using (user_id) where a.item <> b.item group by 1, 2",
    "cf": "select i, j, w / sqrt(x.c * y.c) as sim from cf_w join cnt x on x.item = i join cnt y on y.item = j",
    "sw_users": "select user_id, item from (select *, row_number() over (partition by item order by md5(concat_ws('-', user_id, item, 2020)), user_id) as turn from (select distinct user_id, item from click)) where turn <= 80",
    "sw_items": "select distinct user_id, item from seq where loc < 200",
    "sw_n": "select user_id, count(*) as n from sw_items group by user_id",
    "sw_k": "select a.user_id as u, b.user_id as v, count(*) as k from sw_users a join sw_users b using (item) where a.user_id < b.user_id group by 1, 2",
    "sw_c": "select u, v, count(*) as c from (select u, v, a.item from sw_k join sw_items a on a.user_id = u join sw_items b on b.user_id = v and b.item = a.item) group by 1, 2",
    "sw_pairs": "select u, v, k / (sqrt(x.n) * sqrt(y.n)) / (1e0 + coalesce(c, 0)) as w, coalesce(c, 0) as c from sw_k left join sw_c using (u, v) join sw_n x on x.user_id = u join sw_n y on y.user_id = v",
    "sw": "select a.item as i, b.item as j, 2e0 * sum(w) as sim from sw_pairs join (select u, v, a0.item, a0.turn from (select u, v, a1.item, row_number() over (partition by u, v order by a1.item) as turn from sw_k join sw_items a1 on a1.user_id = u join sw_items b1 on b1.user_id = v and b1.item = a1.item) a0 where a0.turn <= 80) a using (u, v) join (select u, v, item from (select u, v, a2.item, row_number() over (partition by u, v order by a2.item) as turn from sw_k join sw_items a2 on a2.user_id = u join sw_items b2 on b2.user_id = v and b2.item = a2.item) where turn <= 80) b on b.u = sw_pairs.u and b.v = sw_pairs.v and a.item <> b.item group by 1, 2",
    "vecs": "select vec_id as item, cast(embedding as double[]) as v, sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))) as norm from embeddings",
    "knn": "select i, j, sim from (select i, j, sim, row_number() over (partition by i order by sim desc, j) as rn from (select a.item as i, b.item as j, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 9) as sim from vecs a, vecs b)) where i <> j and rn <= 201",
    "prof": "select user_id, array_agg(distinct cat) filter (cat is not null) as cats, avg(case when cat is not null then coalesce(words, 0) end) as mw, arg_max(case when cat is not null then coalesce(created, 0) end, case when cat is not null then -loc end) as lc from seq left join arts using (item) where loc < 50 group by user_id",
    "itemcf_c": "@seeded(cf,2,200,100,seeds)",
    "swing_c": "@seeded(sw,2,80,50,seeds)",
    "coarse": "@seeded(knn,3,200,300,none)",
    "soft": """select c.user_id, c.article_id, c.label,
        c.sim_score - (case when s.item is not null then 1e0 else 0e0 end)
        + (case when a.cat is not null and len(p.cats) > 0 then (case when list_contains(p.cats, a.cat) then 0.6e0 else -0.12e0 end) else 0e0 end)
        + (case when a.cat is not null and p.mw > 0 then 0.4e0 * exp(-abs(coalesce(a.words, 0) - p.mw) / 250e0) else 0e0 end)
        + (case when a.cat is not null and p.lc > 0 then 0.5e0 * exp(-abs((coalesce(a.created, 0) - p.lc) / 86400e0) / 120e0) else 0e0 end) as sim_score
      from coarse c left join prof p using (user_id) left join arts a on a.item = c.article_id left join (select distinct item from click) s on s.item = c.article_id""",
    "cold_top": "@top(soft,50)",
    "cold_c": "select user_id, article_id, label, (case when hi > lo then (sim_score - lo) / (hi - lo) else 0e0 end) + 0.001e0 as sim_score from (select *, min(sim_score) over (partition by user_id) as lo, max(sim_score) over (partition by user_id) as hi from cold_top)",
    "w2v_raw": "select s.user_id, k.j as article_id, k.sim as sim_score from seq s join query using (user_id) join (select i, j, sim from (select *, row_number() over (partition by i order by sim desc, j) as r2 from (select a.item as i, b.item as j, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 9) as sim from vecs a, vecs b)) where r2 <= 100 and i <> j) k on k.i = s.item where s.loc = 0",
    "w2v_l": "select w.*, case when target <> -1 then cast(article_id = target as integer) end as label from w2v_raw w join query using (user_id)",
    "w2v_c": "@top(w2v_l,50)",
    "un_mean": "select user_id, list(x order by dim) as v from (select user_id, dim, avg(x) as x from (select s.user_id, unnest(range(0, len(v))) as dim, unnest(v) as x from seq s join query using (user_id) join vecs on vecs.item = s.item where s.loc < 30) group by 1, 2) group by 1",
    "un_near": "select user_id, article_id, sim_score from (select *, row_number() over (partition by user_id order by sim_score desc, article_id) as rk from (select m.user_id, x.item as article_id, round(list_inner_product(m.v, x.v) / (sqrt(list_sum(list_transform(m.v, lambda z: z * z))) * x.norm), 9) as sim_score from un_mean m, vecs x)) where rk <= 100",
    "un_known": "select user_id, article_id, sim_score from (select n.*, row_number() over (partition by user_id order by sim_score desc, article_id) as rk from un_near n where not exists (select 1 from click z where z.user_id = n.user_id and z.item = n.article_id)) where rk <= 50",
    "un_cold": "select user_id, p.item as article_id, 1e0 - rn * 0.01e0 as sim_score from (select distinct user_id from query where user_id not in (select user_id from click)) cross join (select item, row_number() over (order by c desc, item) - 1 as rn from cnt order by c desc, item limit 50) p",
    "unseen_c": "select user_id, article_id, sim_score, case when target <> -1 then cast(article_id = target as integer) end as label from (select * from un_known union all select * from un_cold) join query using (user_id)",
    "ov": "select distinct user_id, article_id, a from (select user_id, article_id, 'itemcf' as a from itemcf_c union all select user_id, article_id, 'w2v' from w2v_c union all select user_id, article_id, 'swing' from swing_c union all select user_id, article_id, 'cold_start' from cold_c union all select user_id, article_id, 'youtubednn' from unseen_c)",
    "ng_w": "select item, cast(greatest(1, floor(power(c, 0.75e0) * 1048576)) as bigint) as w from cnt",
    "ng_line": "select item, w, cast(sum(w) over (order by md5(cast(item as varchar))) - w as bigint) as lo, row_number() over (order by md5(cast(item as varchar))) - 1 as nth from ng_w",
    "ng_size": "select cast(sum(w) as bigint) as total, count(*) as n from ng_w",
    "fused_s": "select user_id, article_id, sum(s) as sim_score, max(label) as label from (@mm(itemcf_c,1.0) union all @mm(w2v_c,0.2) union all @mm(swing_c,0.8) union all @mm(cold_c,0.06) union all @mm(unseen_c,0.01)) group by 1, 2",
    "fused": "@top(fused_s,150)",
    "ck": "select s.*, cat, words, created // 1000 as cr, t // 1000 as sec, (t // 1000 // 3600) % 24 as hour from seq s left join arts using (item)",
    "lag_": "select *, sec - lag(sec) over (partition by user_id order by pos) as ds, cr - lag(cr) over (partition by user_id order by pos) as dc, t / 1e3 - lag(t / 1e3) over (partition by user_id order by pos) as df from ck",
    "us": "select user_id, avg(dc) as dcm, avg(ds) as dsm, avg(hour) as hm, stddev_samp(hour) as hs, avg(sec - cr) as scm, stddev_samp(sec - cr) as scs, max(cr) as crx, avg(words) as wm, arg_max(words, pos) as lw, arg_max(cr, pos) as lcr, max_by(sec, pos) as lsec, count(distinct cat) as nc, arg_max(cat, pos) as lcat from lag_ group by user_id",
    "usb": "select user_id, avg(dc) as dcm, avg(df) as dfm, avg(sec - cr) as scm, stddev_samp(sec - cr) as scs, stddev_samp(hour) as hs, avg(words) as wm, arg_max_null(words, pos) as lw, arg_max_null(cr, pos) as lcr, max(cr) as crx, max(sec) as lsec, avg(sec) as cm from lag_ group by user_id",
    "cc": "select f.user_id, f.article_id, f.sim_score, f.label, cat, words, created, uc.n as user_id_cnt, ac.c as article_id_cnt, coalesce(kc.n, 0) as category_click_cnt, ukc.n as user_id_category_id_cnt from fused f left join arts on arts.item = f.article_id left join (select user_id, count(*) as n from click group by 1) uc using (user_id) left join cnt ac on ac.item = f.article_id left join (select cat as kcat, count(*) as n from ck where cat is not null group by 1) kc on kc.kcat = cat left join (select user_id as uu, cat as ucat, count(*) as n from ck where cat is not null group by 1, 2) ukc on uu = f.user_id and ucat = cat",
    "cfsum": "select f.user_id, f.article_id, sum(power(0.7e0, loc) * sim) as s from fused f join seq on seq.user_id = f.user_id and loc < 20 join cf on cf.i = seq.item and cf.j = f.article_id group by 1, 2",
    "cfall": "select f.user_id, f.article_id, sum(power(0.7e0, loc) * sim) as s from fused f join seq on seq.user_id = f.user_id join cf on cf.i = seq.item and cf.j = f.article_id group by 1, 2",
    "w2s": "select f.user_id, f.article_id, max(case when loc = 0 then c end) as l, sum(case when c > -1 then c end) as s from (select f0.user_id, f0.article_id, loc, list_inner_product(h.v, x.v) / (h.norm * x.norm) as c from fused f0 join seq on seq.user_id = f0.user_id and loc < 2 join vecs h on h.item = seq.item join vecs x on x.item = f0.article_id) f group by 1, 2",
}


def _macros(sql: str) -> str:
    def seeded(m):
        e, seeds, top, k, ex = m[1].split(",")
        gone = "" if ex == "none" else f"where not exists (select 1 from seq z where z.user_id = d.user_id and z.loc < {seeds} and z.item = d.article_id)"
        return f"""select user_id, article_id, sim_score, case when target <> -1 then cast(article_id = target as integer) end as label from (
          select *, row_number() over (partition by user_id order by round(sim_score, 9) desc, article_id) as rk from (
            select s.user_id, e.j as article_id, sum(power(0.7e0, s.loc) * e.sim) as sim_score from seq s join query using (user_id)
            join (select *, row_number() over (partition by i order by round(sim, 9) desc, j) as rn from {e}) e on e.i = s.item and rn <= {top}
            where s.loc < {seeds} group by 1, 2) d {gone}) join query using (user_id) where rk <= {k}"""

    def top(m):
        c, k = m[1].split(",")
        return f"select user_id, article_id, sim_score, label from (select *, row_number() over (partition by user_id order by round(sim_score, 9) desc, article_id) as rk from {c}) where rk <= {k}"

    def mm(m):
        c, w = m[1].split(",")
        return f"(select user_id, article_id, label, {w}e0 * (coalesce((sim_score - lo) / nullif(hi - lo, 0e0), 1e0) + 0.001e0) as s from (select *, min(sim_score) over (partition by user_id) as lo, max(sim_score) over (partition by user_id) as hi from {c}))"

    for name, f in (("seeded", seeded), ("top", top), ("mm", mm)):
        sql = re.sub(rf"@{name}\(([^)]*)\)", f, sql)
    return sql


def oracle(select: str) -> str:
    """``select`` with the parts it needs as common table expressions."""
    select, order = _macros(select), []

    def need(text: str) -> None:
        for word in re.findall(r"\b\w+\b", text):
            if word in PARTS and word not in order and not re.search(rf"\bas {word}\b", text):
                body = _macros(PARTS[word])
                need(body)
                if word not in order:
                    order.append(word)

    need(select)
    return "with " + ",\n".join(f"{n} as ({_macros(PARTS[n])})" for n in order) + "\n" + select
