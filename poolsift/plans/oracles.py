"""DuckDB SQL for the registered queries, written without looking at the plans.

Views are plain definitions: global windows, no buckets, no cuts. Only the view of the
results log shares its text with the Spark side, as it is an input.
"""

import re

from poolsift.plans.fixtures import RESULTS_SQL

LABELS_SQL = "['de','en','es','fr']"
BASE = "('BASE', 'base_classifier')"


def _hash(seed, column="id"):
    return f"md5('{seed}:' || cast({column} as varchar))"


def _metric(key):
    return f"""try_cast(json_extract_string(case when json_valid(metrics) then metrics end, '$."{key}"') as double)"""


def _logits_sql():
    """Four sums per member: every twelfth of the 64 dimensions, from a start that the member gives."""
    sums = [
        " + ".join(f"coalesce(cast(embedding[{12 * k + j + 1} + 4 * m] as double), 0)" for k in range(6)) for j in range(4)
    ]
    return "[" + ", ".join(sums) + "]"


def _bayes_sql(features):
    """(id, probs): naive Bayes over hashed words, trained on the revealed rows of the pool."""
    return f"""
        (with tok as (
          select r.id, r.label, p.is_labelled, w, ('0x' || substr(md5(w), 1, 6))::bigint % {features} b
          from (select id, label, description, unnest(string_split_regex(lower(description), '[ \\t\\n\\r]+')) w from fx_rows) r
          join fx_pool p on p.id = r.id where w <> ''),
        seen as (select id, label from fx_pool where is_labelled and description <> '' and label <> ''),
        cls as (select unnest({LABELS_SQL}) label),
        wt as (select label, (select count(*) from seen) / greatest(count(seen.id), 1) weight from cls left join seen using (label) group by label),
        cnt as (select label, b, count(*) * any_value(weight) n from tok join seen using (id, label) join wt using (label) group by label, b),
        tot as (select label, coalesce(sum(n), 0) s from cls left join cnt using (label) group by label),
        lg as (
          select tot.label, r.b, ln((coalesce(n, 0) + 1) / (s + {features})) l
          from tot cross join (select unnest(range({features})) b) r left join cnt on cnt.label = tot.label and cnt.b = r.b),
        tf as (select id, b, count(*) n from tok group by id, b),
        sc as (
          select fx_rows.id, cls.label, coalesce(sum(n * l), 0) s from fx_rows cross join cls
          left join tf on tf.id = fx_rows.id left join lg on lg.b = tf.b and lg.label = cls.label group by fx_rows.id, cls.label),
        ex as (select id, label, exp(s - max(s) over (partition by id)) e from sc)
        select id, list(e / t order by label) probs from (select *, sum(e) over (partition by id) t from ex) group by id)"""


def _words_sql(features):
    """(id, b, n): how often each bucket of hashed words occurs in a text; and the labels."""
    return f"""
        tf as materialized (
          select id, b, count(*) n from (
            select id, ('0x' || substr(md5(w), 1, 6))::bigint % {features} b
            from (select id, unnest(string_split_regex(lower(description), '[ \\t\\n\\r]+')) w from fx_rows) where w <> '')
          group by id, b),
        cls as (select unnest({LABELS_SQL}) label),"""


def _chosen(probs="probs"):
    return f"({LABELS_SQL})[list_position({probs}, list_max({probs}))]"


def _softmax_sql(query, features, max_iter, rate=0.5, ridge=0.001):
    """Full-batch gradient steps written out, then ``query`` over ``sm`` (id, probs) or the weights ``w``."""
    parts = [
        _words_sql(features),
        f"""
        seen as (select id, label from fx_pool where is_labelled and description <> '' and label in (select label from cls)),
        wt as (select label, (select count(*) from seen) / greatest(count(seen.id), 1) weight from cls left join seen using (label) group by label),
        total as (select sum(weight) s from seen join wt using (label)),
        df as (select b, count(*) df from tf join seen using (id) group by b),
        idf as materialized (
          select b, ln(((select count(*) from seen) + 1.0)::double / (coalesce(df, 0) + 1.0)) idf from range({features}) r(b) left join df using (b)
          union all select {features}, 1.0),
        lens as (select id, sum(n) s from tf group by id),
        vec as materialized (
          select id, b, n / sqrt(s) v from tf join lens using (id) union all select id, {features}, 1.0 from fx_rows),
        w0 as (select b, label, 0.0::double w from idf cross join cls),""",
    ]
    for k in range(max_iter + 1):
        rows = "seen" if k < max_iter else "(select id, null as label from fx_rows)"
        parts.append(f"""
        z{k} as materialized (
          select vec.id, w{k}.label, sum(v * idf * w) z from vec join {rows} t on t.id = vec.id join idf using (b) join w{k} on w{k}.b = vec.b group by all),
        e{k} as (select id, label, exp(z - max(z) over (partition by id)) e from z{k}),
        p{k} as materialized (select id, label, e / sum(e) over (partition by id) p from e{k}),""")
        if k < max_iter:
            parts.append(f"""
        r{k} as (select p{k}.id, p{k}.label, (p - case when seen.label = p{k}.label then 1 else 0 end) * weight r
          from p{k} join seen on seen.id = p{k}.id join wt on wt.label = seen.label),
        g{k} as materialized (select b, label, sum(r * v) g from r{k} join vec using (id) group by all),
        w{k + 1} as materialized (
          select w{k}.b, w{k}.label, w - {rate} * (coalesce(g, 0) * idf / (select s from total) + {ridge} * w) w
          from w{k} join idf using (b) left join g{k} on g{k}.b = w{k}.b and g{k}.label = w{k}.label),""")
    parts.append(f"""
        sm as (select id, list(p order by label) probs from p{max_iter} group by id)
        {query.replace("WEIGHTS", f"w{max_iter}")}""")
    return "".join(parts)


def _diversity_sql(n, passes=5, per_centre=40, rounds=4, overlap=4, seed=42):
    """Priority sample, weighted passes through a two-level tree of centres, the closest rows; passes written out."""
    size, step = per_centre * n, -(-n // rounds)

    def near(rows, centres, out, k):
        """(id, cluster, far) of rows (id, v) by way of the closest root."""
        roots = 2 * next(r for r in range(1, k + 1) if r * r >= k)

        def best(left, key, pairs, most=1):
            return f"""select {key}, cluster, far from (
                select {left}.{key}, c.cluster, round(pow(list_distance({left}.v, c.v), 2), 6) far,
                  row_number() over (partition by {left}.{key} order by round(pow(list_distance({left}.v, c.v), 2), 6), c.cluster) k
                from {pairs}) where k <= {most}"""

        return f"""
          {out}_t as materialized (select cluster id, v from {centres}),
          {out}_o as materialized ({best(f"{out}_t", "id", f"{out}_t join {centres} c on c.cluster <= {roots}", overlap)}),
          {out}_r as materialized ({best(rows, "id", f"{rows} join {centres} c on c.cluster <= {roots}")}),
          {out} as materialized ({best(rows, "id", f"{rows} join {out}_r r on r.id = {rows}.id join {out}_o o on o.cluster = r.cluster join {centres} c on c.cluster = o.id")}),"""

    parts = [
        f"""pt as materialized (
            select vec_id id, cast(embedding as double[]) v from embeddings join fx_pool p on p.id = vec_id
            where not p.is_labelled and p.description <> '' and p.label <> ''),
          mean as (select list(x order by i) v from (
            select i, round(avg(x), 6) x from (select unnest(range(1, len(v) + 1)) i, unnest(v) x from pt) group by i)),
          apart as (select id, cast(round(1e6 * pow(list_distance(pt.v, mean.v), 2)) as bigint) s from pt, mean),
          q as (select id, 0.5::double / (select count(*) from apart) + 0.5::double * s / (select sum(s) from apart) q from apart),
          rk as materialized (select *, row_number() over (order by score, id) k from (
            select id, q, (('0x' || substr({_hash(seed)}, 1, 8))::bigint + 0.5::double) / 4294967296::double / q score from q)),
          sample as materialized (
            select id, v, greatest(1, 1 / ((select score from rk where k = {size + 1}) * q)) w from rk join pt using (id) where k <= {size}),
          s0 as materialized (select * from (
            select row_number() over (order by ('0x' || substr({_hash(f"{seed}/0")}, 1, 8))::bigint, id) as cluster, v from sample) where cluster <= {step}),"""
    ]
    last = "s0"
    for had in range(step, n, step):
        parts.append(near("sample", last, f"d{had}", had))
        parts.append(f"""
          s{had} as materialized (select * from {last} union all select * from (
            select {had} + row_number() over (order by case when far > 0 then
              (('0x' || substr({_hash(f"{seed}/{had}")}, 1, 8))::bigint + 0.5::double) / 4294967296::double / (w * far) end nulls last, id) as cluster, v
            from sample join d{had} using (id)) where cluster <= {min(had + step, n)}),""")
        last = f"s{had}"
    parts.append(f"""
          c0 as (select * from {last}),""")
    for p in range(passes):
        parts.append(near("sample", f"c{p}", f"n{p}", n))
        parts.append(f"""
          m{p} as (select cluster, list(x order by i) v from (
            select cluster, i, round(sum(w * x) / sum(w), 6) x from (
              select cluster, w, unnest(range(1, len(v) + 1)) i, unnest(v) x from sample join n{p} using (id)) group by cluster, i) group by cluster),
          c{p + 1} as materialized (select cluster, coalesce(m{p}.v, c{p}.v) v from c{p} left join m{p} using (cluster)),""")
    parts.append(near("pt", f"c{passes}", "fin", n))
    parts.append(f"""
          best as (select id, 0 late, '' h from (
            select id, row_number() over (partition by cluster order by far, id) k from fin) where k = 1),
          chosen as (select id from (
            select * from best union all
            select id, 1, {_hash(f"{seed}/0")} from sample where id not in (select id from best)) order by late, h, id limit {n})
        select id, label from chosen join fx_pool using (id)""")
    return "".join(parts)


def _loop_sql(n, max_iterations, features):
    """Every iteration of the loop written out: a model of the known rows, its scores, the rows it chooses."""
    parts = [
        _words_sql(features),
        """
        rest as materialized (
          select id, label, is_labelled from fx_pool where id not in (select id from fx_test) and description <> '' and label <> ''),
        tested as (select id, label from fx_test where description <> '' and label in (select label from cls)),
        known0 as (select id, label from rest where is_labelled),""",
    ]
    for k in range(max_iterations + 1):
        parts.append(f"""
        wt{k} as (select label, (select count(*) from known{k}) / greatest(count(known{k}.id), 1) weight from cls left join known{k} using (label) group by label),
        cnt{k} as (select label, b, sum(n) * any_value(weight) n from tf join known{k} using (id) join wt{k} using (label) group by label, b),
        tot{k} as (select label, coalesce(sum(n), 0) s from cls left join cnt{k} using (label) group by label),
        lg{k} as materialized (
          select tot{k}.label, r.b, ln((coalesce(n, 0) + 1) / (s + {features})) l
          from tot{k} cross join range({features}) r(b) left join cnt{k} on cnt{k}.label = tot{k}.label and cnt{k}.b = r.b),
        asked{k} as (select id from tested union all select id from rest where id not in (select id from known{k})),
        sc{k} as (
          select a.id, cls.label, coalesce(sum(n * l), 0) s from asked{k} a cross join cls
          left join tf on tf.id = a.id left join lg{k} on lg{k}.b = tf.b and lg{k}.label = cls.label group by a.id, cls.label),
        ex{k} as (select id, label, exp(s - max(s) over (partition by id)) e from sc{k}),
        pr{k} as materialized (
          select id, list(e / t order by label) probs from (select *, sum(e) over (partition by id) t from ex{k}) group by id),
        hit{k} as (select tested.label, {_chosen()} predicted from pr{k} join tested using (id)),
        f1{k} as (
          select cls.label, 2.0 * count(*) filter (hit.label = cls.label and predicted = cls.label)
            / greatest(count(*) filter (hit.label = cls.label) + count(*) filter (predicted = cls.label), 1) f1
          from cls cross join hit{k} hit group by cls.label),
        open{k} as materialized (select id, rest.label, round(1 - list_max(probs), 6) u from pr{k} join rest using (id)),
        batch{k} as (select id, label, u from open{k} order by u desc, id limit {n}),
        known{k + 1} as (select id, label from known{k} union all select id, label from batch{k}),""")
    rows = [
        """select 1 as id, '1' as test_id, 0 as iteration_no, 0 as train_data_size, 'BASE' as method,
          (select avg(case when label = predicted then 1.0 else 0.0 end) from hit0) accuracy, null::double macro_f1,
          null::double avg_uncertainty_pool, null::double selected_samples_avg_uncertainty, 'base_classifier' as notes"""
    ]
    for k in range(1, max_iterations + 1):
        note = "continue" if k < max_iterations else f"max_iterations_reached ({k})"
        size = " + ".join(f"(select count(*) from batch{i})" for i in range(k))
        rows.append(f"""select {k + 1}, '1', {k}, {size}, 'uncertainty_sampling',
          (select avg(case when label = predicted then 1.0 else 0.0 end) from hit{k}), (select avg(f1) from f1{k}),
          (select avg(u) from open{k - 1}), (select avg(u) from batch{k - 1}), '{note}'
          where exists (select 1 from batch{k - 1})""")
    measures = ", ".join(r6(m, m) for m in ("accuracy", "macro_f1", "avg_uncertainty_pool", "selected_samples_avg_uncertainty"))
    parts.append(f"""
        log as ({" union all ".join(rows)})
        select cast(id as bigint) id, test_id, cast(iteration_no as bigint) iteration_no, cast(train_data_size as bigint) train_data_size,
          method, {measures}, notes from log""")
    return "".join(parts)


VIEWS = {
    "fx_rows": "select doc_id id, text description, lang as label, source from documents",
    "fx_scores": """
        select id, member, list_transform(e, lambda x: x / list_sum(e)) probs from (
          select vec_id id, m member,
            list_transform(_LOGITS_, lambda x: exp(16 * x)) e
          from embeddings, (select unnest([0, 1, 2]) m))""".replace("_LOGITS_", _logits_sql()),
    "fx_pred": f"""
        select s.id, s.member, s.probs, r.label, r.description,
          list_position(s.probs, list_max(s.probs)) - 1 predicted_class,
          ({LABELS_SQL})[list_position(s.probs, list_max(s.probs))] predicted_label,
          list_max(s.probs) confidence,
          r.label = ({LABELS_SQL})[list_position(s.probs, list_max(s.probs))] ok
        from fx_scores s join fx_rows r on r.id = s.id""",
    "fx_pool": """
        select r.id, r.description, l.doc_id is not null is_labelled, r.label,
          cast(list_position(s.probs, list_max(s.probs)) - 1 as varchar) model_prediction,
          round(1 - list_max(s.probs), 6) uncertainty_score
        from fx_rows r left join labels l on l.doc_id = r.id
        left join fx_scores s on s.id = r.id and s.member = 0""",
    "fx_test": f"""
        select * from (
          select *, row_number() over (order by {_hash(42)}, id) k, count(*) over () n
          from fx_pool where description <> '' and label <> '')
        where k <= floor(n * 0.2)""",
    "fx_results": RESULTS_SQL.format(orders="orders", customer="customer"),
    "fx_log": f"""
        select *, {_metric('accuracy')} accuracy, {_metric('macro_f1')} macro_f1,
          {_metric('avg_uncertainty_pool')} avg_uncertainty_pool,
          {_metric('selected_samples_avg_uncertainty')} selected_samples_avg_uncertainty,
          {_metric('recall_contract')} recall_contract, {_metric('recall_internship')} recall_internship,
          {_metric('recall_volunteer')} recall_volunteer, {_metric('recall_temporary')} recall_temporary,
          {_metric('recall_full-time')} recall_full_time
        from fx_results""",
    "fx_runs": """
        select *, cast(sum(case when iteration_no = 0 or upper(method) = 'BASE' or method = 'base_classifier'
            or notes = 'base_classifier' or id = first_id then 1 else 0 end) over (order by id) as bigint) run
        from (select *, min(id) over () first_id from fx_log)""",
    "fx_valid": f"select * from fx_log where method not in {BASE}",
    "fx_f1": "select * from fx_valid where macro_f1 is not null",
    "fx_entries": f"""
        select run, iteration_no, k as metric,
          try_cast(json_extract_string(metrics, '$."' || k || '"') as double) as value
        from (select run, iteration_no, metrics, unnest(json_keys(metrics)) k from fx_runs where json_valid(metrics))""",
    "fx_curve": """
        select method, train_data_size, coalesce(accuracy, 0) accuracy, coalesce(macro_f1, 0) macro_f1 from (
          select *, row_number() over (partition by method, train_data_size order by id desc) k from fx_valid)
        where k = 1""",
    "fx_base_curve": "select * from fx_curve where method = 'random_sampling'",
    "fx_final": """
        select method, train_data_size, accuracy, macro_f1 from (
          select *, row_number() over (partition by method order by train_data_size desc) k from fx_curve)
        where k = 1""",
    "fx_reached": """
        select method, metric, target, cast(min(train_data_size) as bigint) labels from (
          select method, train_data_size, 'accuracy' metric, accuracy as value from fx_curve
          union all select method, train_data_size, 'macro_f1', macro_f1 from fx_curve) c,
          (select unnest([0.3::double, 0.4::double, 0.5::double, 0.6::double]) target) t
        where value >= target group by 1, 2, 3""",
    "fx_pairs": """
        select a.method, a.p, a.macro_f1 f1, b.macro_f1 base_f1 from (
          select method, macro_f1, row_number() over (partition by method order by id) p from fx_f1) a
        join (select macro_f1, row_number() over (order by id) p from fx_f1 where method = 'random_sampling') b
          on a.p = b.p
        where a.method <> 'random_sampling'""",
    "fx_pair_stats": """
        select method, count(*) pairs, avg(f1 - base_f1) mean_diff, avg(f1 - base_f1) / avg(base_f1) * 100 mean_diff_pct,
          avg(f1 - base_f1) / (stddev_samp(f1 - base_f1) / sqrt(count(*))) t_statistic,
          avg(f1 - base_f1) / sqrt(((count(*) - 1) * var_samp(f1) + (count(*) - 1) * var_samp(base_f1)) / (2 * count(*) - 2)) cohens_d,
          arg_max(f1, p) method_final_f1, arg_max(base_f1, p) random_final_f1
        from fx_pairs group by method""",
    "fx_last": """
        select method, macro_f1, train_data_size labels from (
          select *, row_number() over (partition by method order by id desc) k from fx_f1) where k = 1""",
    "fx_combined": "select *, (macro_f1 + accuracy) / 2 combined from fx_valid",
    "fx_best_combined": """
        select * from (
          select *, row_number() over (partition by method order by combined desc, id) k,
            min(id) over (partition by method) first_id
          from fx_combined where combined is not null) where k = 1""",
    "fx_best": """
        select method, first_id, macro_f1 final_f1, accuracy final_accuracy, train_data_size final_labels,
          avg_uncertainty_pool, selected_samples_avg_uncertainty,
          recall_contract, recall_internship, recall_volunteer, recall_temporary,
          coalesce((coalesce(recall_contract, 0) + coalesce(recall_internship, 0) + coalesce(recall_volunteer, 0)
            + coalesce(recall_temporary, 0))
            / nullif((recall_contract is not null)::int + (recall_internship is not null)::int
              + (recall_volunteer is not null)::int + (recall_temporary is not null)::int, 0), 0) avg_minority_recall
        from (select *, row_number() over (partition by method order by macro_f1 desc, id) k,
            min(id) over (partition by method) first_id from fx_f1) where k = 1""",
    "fx_best_long": """
        select method, first_id, final_labels, 'final_f1' metric, final_f1 as value from fx_best
        union all select method, first_id, final_labels, 'final_accuracy', final_accuracy from fx_best
        union all select method, first_id, final_labels, 'avg_minority_recall', avg_minority_recall from fx_best""",
    "fx_report": f"""
        select l.label, coalesce(t.support, 0) support,
          coalesce(t.hits / nullif(p.n, 0), 0) as prec, coalesce(t.hits / nullif(t.support, 0), 0) as rec
        from (select unnest({LABELS_SQL}) label) l
        left join (select label, count(*) support, sum(ok::int) hits from fx_pred group by 1) t on t.label = l.label
        left join (select predicted_label, count(*) n from fx_pred group by 1) p on p.predicted_label = l.label""",
    "fx_report_f1": "select *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) f1 from fx_report",
    "fx_folds": f"""
        select id, label, ok, confidence,
          ntile(5) over (partition by label order by {_hash(42)}, id) - 1 as sfold,
          ntile(5) over (order by {_hash(42)}, id) - 1 as fold
        from fx_pred where member = 0""",
    "fx_steps": """
        select *, lag(accuracy) over (partition by run order by id) previous_accuracy,
          lag(train_data_size) over (partition by run order by id) size_before
        from fx_runs""",
    "fx_plateau": """
        select r.*, s.streak, coalesce(s.streak >= 2, false) plateau from fx_runs r left join (
          select id, cast(sum(flat) over (partition by run, island order by id) as bigint) streak from (
            select id, run, flat, sum(1 - flat) over (partition by run order by id) island from (
              select id, run, case when lag(selected_samples_avg_uncertainty) over (partition by run order by id)
                  - selected_samples_avg_uncertainty < 0.05 then 1 else 0 end flat
              from fx_runs where selected_samples_avg_uncertainty is not null))) s on s.id = r.id""",
    "fx_js": """
        select id, round(list_sum(list_transform(ps, lambda p: list_sum(list_transform(range(1, len(m) + 1),
            lambda i: case when p[i] > 0 then p[i] * ln(p[i] / (m[i] + 1e-12) + 1e-12) else 0 end)))) / len(ps), 6) js,
          round(-list_sum(list_transform(m, lambda x: x * ln(x + 1e-12))), 6) mean_entropy,
          round(-list_sum(list_transform(m, lambda x: x * ln(x + 1e-12))) / ln(len(m) + 1e-12), 6) normalized_entropy
        from (select id, ps, list_transform(range(1, 5), lambda i: list_avg(list_transform(ps, lambda p: p[i]))) m
          from (select id, list(probs order by member) ps from fx_scores group by id))""",
    "fx_votes": """
        select id, count(distinct list_position(probs, list_max(probs))) votes,
          round(avg(-list_sum(list_transform(probs, lambda p: p * ln(p + 1e-12)))), 6) vote_entropy
        from fx_scores group by id""",
    "fx_unc": """
        select id, label, row_number() over (order by uncertainty_score desc, id) as rank
        from fx_pool where not is_labelled and uncertainty_score is not null""",
    "fx_counts": f"select label, count(*) n from fx_rows group by label",
}

NAME = re.compile(r"\bfx_\w+")


def _needed(text: str, seen: list) -> list:
    for name in NAME.findall(text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def sql(body: str) -> str:
    """A query with the views it uses in front."""
    views = _needed(body, [])
    if not views:
        return body
    return "with " + ",\n".join(f"{v} as materialized ({VIEWS[v]})" for v in views) + "\n" + body


def r6(expression: str, alias: str) -> str:
    return f"round({expression}, 6) + 0.0 as {alias}"


def _tail(f, d1, d2):
    """P(F(d1, d2) > f) by Simpson's rule over cos^(d2-1) sin^(d1-1)."""
    upper = f"least(pi() / 2, (sqrt({d1}) + 12) / sqrt({d2}))"
    lower = f"least(atan(sqrt({d1} * {f} / {d2})), {upper})"

    def area(start):
        step = f"(({upper}) - ({start})) / 2000"
        point = f"(({start}) + i * {step})"
        weight = "case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end"
        return (
            f"list_sum(list_transform(range(0, 2001), lambda i: ({weight}) "
            f"* pow(greatest(cos({point}), 0), {d2} - 1) * pow(sin({point}), {d1} - 1))) * {step} / 3"
        )

    return f"({area(lower)}) / ({area('0::double')})"


STARS = "case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' else 'ns' end"
P_PAIRED = _tail("cast(t_statistic * t_statistic as double)", "1::double", "cast(pairs - 1 as double)")

_RAW = {
    # sources and sinks
    "read_postings_csv": """select cast(doc_id as varchar) job_id, text description, lang formatted_work_type,
        source company_name from documents""",
    "read_results": """select * replace (cast(iteration_no as bigint) as iteration_no, nullif(model_name, '') as model_name,
          null::double as t, null::varchar as run_by), cast(2024 as bigint) created_at, 'h' || id as host from fx_results""",
    "read_results_unnamed": "select id, method, metrics, notes, null::bigint train_data_size from fx_results",
    "read_jsonl": """select case when event_type <> 'signup' then cast(props::json->>'k' as bigint) end k
        from events where event_type <> 'error'""",
    "read_jsonl_keys": "select props::json->>'k' k from events",
    "head_rows": "select id, description, label, source from fx_rows order by id limit 100",
    "write_table_csv": f"""
        select 'pool' as name, count(*) as rows, cast(sum(id) as bigint) ids, cast(sum(length(description)) as bigint) chars,
          {r6('sum(uncertainty_score)', 'score')} from fx_pool where id not in (select id from fx_test)
        union all
        select 'test_data', count(*), cast(sum(id) as bigint), cast(sum(length(description)) as bigint),
          round(sum(uncertainty_score), 6) + 0.0 from fx_test
        union all
        select 'results', count(*), cast(sum(id) as bigint), cast(sum(length(metrics)) as bigint),
          cast(sum(train_data_size) as double) from fx_results""",
    "write_json": "select * from ({compare_models})",
    "pool_from_postings": """select row_number() over (order by doc_id) id, text description, false is_labelled, lang as label
        from documents where text <> '' and lang <> ''""",
    "results_append": f"""
        select id, test_id, cast(iteration_no as bigint) iteration_no, method, {r6('accuracy', 'accuracy')}, notes from fx_log
        union all select max(id) + 1, '99', 1, 'random_sampling', 0.5, 'continue' from fx_log""",
    "next_test_id": "select max(cast(test_id as bigint)) + 1 next_test_id from fx_results where regexp_full_match(test_id, '[0-9]+')",
    "union_results": f"""
        select id, method, train_data_size, null::bigint iteration_no, null::varchar notes from fx_results where method in {BASE}
        union all select id, method, null, iteration_no, notes from fx_results where method not in {BASE}""",
    # filters, projections, scalars
    "unlabelled_page": """select id, description, is_labelled, label from fx_pool where not is_labelled
        order by id limit 50 offset 25""",
    "unlabelled_with_labels": """select id, description, label from fx_pool
        where not is_labelled and description <> '' and label <> ''""",
    "labelled_rows": "select id, description, label from fx_pool where is_labelled and description <> '' and label <> ''",
    "test_page": "select id, label, is_labelled from fx_test order by id limit 20 offset 10",
    "unlabelled_count": """select count(*) unlabelled from fx_pool
        where not is_labelled and description <> '' and label <> ''""",
    "label_filter": "select id, label from fx_rows where label in ('de', 'fr') and description <> ''",
    "label_rejects": """select label, count(*) dropped, cast(sum(count(*)) over () as bigint) dropped_in_all from fx_rows
        where label not in ('de', 'fr') and label <> '' and description <> '' group by label""",
    "label_encode": """select id, label, cast(case label when 'de' then 0 when 'en' then 1 when 'fr' then 2 end as bigint) label_code
        from fx_rows""",
    "label_decode": f"""select vec_id id, cast(e.label as bigint) as cluster,
        case when e.label between 0 and 3 then ({LABELS_SQL})[e.label + 1] end as name from embeddings e""",
    "truncate_tokens": r"""
        select id, array_to_string(list_filter(regexp_split_to_array(description, '[ \t\n\r\f]+'), lambda w: w <> '')[1:256], ' ') as text
        from fx_rows""",
    "normalize_probs": """
        select id, missing, case when missing then null else round(x / s, 6) + 0.0 end p from (
          select id, s, s <= 0 missing, unnest(case when s <= 0 then [null::double] else v end) x from (
            select vec_id id, v, list_sum(v) s from (
              select vec_id, list_transform(embedding, lambda x: cast(x as double) + 0.05) v from embeddings)))""",
    "softmax_predict": f"""
        select id, list_position(p, list_max(p)) - 1 predicted_class, {r6('list_max(p)', 'confidence')},
          {r6('1 - list_max(p)', 'uncertainty')}
        from (select id, list_transform(e, lambda x: x / list_sum(e)) p from (
          select vec_id id, list_transform(embedding, lambda x: exp(cast(x as double))) e from embeddings))""",
    "entropy": f"""
        select id, cast(member as bigint) as member, {r6('h', 'entropy')}, {r6('h / ln(4 + 1e-12)', 'normalized')}
        from (select id, member, -list_sum(list_transform(probs, lambda p: p * ln(p + 1e-12))) h from fx_scores)""",
    "parse_metrics": f"""
        select id, k as key, round(try_cast(json_extract_string(metrics, '$."' || k || '"') as double), 6) + 0.0 as value
        from (select id, metrics, unnest(json_keys(metrics)) k from fx_results where metrics <> 'nan')
        union all select id, null, null from fx_results where metrics = 'nan'""",
    "extract_metric": f"""select id, {r6('accuracy', 'accuracy')}, {r6('macro_f1', 'macro_f1')},
        {r6('recall_internship', 'recall_internship')} from fx_log""",
    "drop_base_rows": f"select id, method, cast(iteration_no as bigint) iteration_no from fx_results where method not in {BASE}",
    "normalize_model_name": r"""select id, case when coalesce(model_name, '') = '' then 'unknown'
        else regexp_replace(model_name, '^(.*?) \(.*\)$', '\1') end model_name from fx_results""",
    "significance_stars": f"""select id, cast(member as bigint) as member, {STARS} stars
        from (select id, member, probs[1] p_value from fx_scores)""",
    # joins
    "fetch_selected": "select id, description, label from fx_pool where id in (select doc_id from labels where toxic = 1)",
    "remaining_pool": f"""select id, label, {r6('uncertainty_score', 'uncertainty_score')} from fx_pool
        where id not in (select doc_id from labels)""",
    "committee_by_id": f"""select id, count(*) over (partition by id) members,
        row_number() over (partition by id order by member) - 1 place, cast(member as bigint) as member,
        {r6('probs[1]', 'p0')}, {r6('probs[2]', 'p1')}, {r6('probs[3]', 'p2')}, {r6('probs[4]', 'p3')} from fx_scores""",
    "common_sizes": f"""select c.train_data_size, c.method, {r6('c.accuracy', 'accuracy')}, {r6('c.macro_f1', 'macro_f1')},
        {r6('b.accuracy', 'base_accuracy')}, {r6('b.macro_f1', 'base_macro_f1')}
        from fx_curve c join fx_base_curve b on b.train_data_size = c.train_data_size where c.method <> 'random_sampling'""",
    # labelling state
    "save_predictions": f"""
        select p.id, case when s.id is not null then cast(list_position(s.probs, list_max(s.probs)) - 1 as varchar)
            else p.model_prediction end model_prediction,
          round(case when s.id is not null then 1 - list_max(s.probs) else p.uncertainty_score end, 6) + 0.0 uncertainty_score,
          p.is_labelled
        from fx_pool p left join (
          select * from fx_scores where member > 0 qualify row_number() over (
            partition by id order by round(1 - list_max(probs), 6) desc, list_position(probs, list_max(probs)) desc) = 1) s on s.id = p.id""",
    "apply_labels": """select r.id, coalesce(l.quality = 1, false) is_labelled,
        case when l.quality = 1 then 'good' else r.label end as label from fx_rows r left join labels l on l.doc_id = r.id""",
    "mark_labelled": """select p.id, p.is_labelled or e.vec_id is not null is_labelled, p.label
        from fx_pool p left join embeddings e on e.vec_id = p.id and e.label = 3""",
    "store_updates": f"""
        best as (
          select *, row_number() over (partition by id order by round(1 - list_max(probs), 6) desc, list_position(probs, list_max(probs)) desc) k
          from fx_scores where member > 0),
        again as (select s.* from fx_scores s join labels l on l.doc_id = s.id and l.toxic = 1 where member = 0),
        last as (
          select id, probs from again union all select id, probs from best where k = 1 and id not in (select id from again))
        select p.id, coalesce(l.quality = 1, false) or e.vec_id is not null is_labelled,
          case when l.quality = 1 then 'good' else p.label end as label,
          case when s.id is not null then cast(list_position(s.probs, list_max(s.probs)) - 1 as varchar) else p.model_prediction end model_prediction,
          round(case when s.id is not null then 1 - list_max(s.probs) else p.uncertainty_score end, 6) + 0.0 uncertainty_score,
          length(p.description) chars
        from fx_pool p left join labels l on l.doc_id = p.id left join embeddings e on e.vec_id = p.id and e.label = 3
        left join last s on s.id = p.id""",
    "reset_pool": """select id, false is_labelled, null::varchar as label, null::varchar model_prediction,
        null::double uncertainty_score from fx_rows""",
    "reset_counts": """select count(*) filter (description is not null) labels_cleared,
        count(*) filter (model_prediction is not null or uncertainty_score is not null) predictions_cleared from fx_pool""",
    "init_labelled": f"""
        select p.id, p.is_labelled or coalesce(s.k <= least(1000, s.n, greatest(1, floor(s.n * 0.1))), false) is_labelled, p.label
        from fx_pool p left join (
          select id, row_number() over (order by {_hash(7)}, id) k, count(*) over () n from fx_pool
          where not is_labelled and label <> '') s on s.id = p.id""",
    "split_test": "select id, description, label, is_labelled from fx_test",
    "split_remaining": f"""select id, label, is_labelled from fx_pool where id not in (
        select id from fx_pool where description <> '' and label <> '' order by {_hash(42)}, id limit 75)""",
    "committee_upsert": """
        select s.id, cast(s.member as bigint) as member,
          cast(list_position(s.probs, list_max(s.probs)) - 1 + case when l.doc_id is not null then 10 else 0 end as bigint) predicted_class
        from fx_scores s left join labels l on l.doc_id = s.id""",
    # sampling and balancing
    "random_sampling": f"""select id, description, label from fx_pool where not is_labelled and description <> ''
        order by {_hash(42)}, id limit 100""",
    "fallback_random": f"""select id, label from fx_pool where not is_labelled and description <> '' and label <> ''
        order by {_hash(5)}, id limit 40""",
    "sample_n": f"select id, label from fx_rows order by {_hash(3)}, id limit 120",
    "train_test_split": f"""select id, label, case when k <= ceil(n * 0.2) then 'test' else 'train' end as part from (
        select id, label, row_number() over (order by {_hash(42)}, id) k, count(*) over () n from fx_rows)""",
    "stratified_subsample": f"""
        with_ranked as (select u.id, u.label, u.rank from fx_unc u where u.rank <= 250),
        sizes as (select label, count(*) n, min(rank) seen from with_ranked group by label),
        quotas as (select *, least(n, 50 // count(*) over () +
            case when row_number() over (order by {_hash(42, 'label')}, label) <= 50 % count(*) over () then 1 else 0 end) q,
            sum(n) over () total from sizes),
        placed as (select r.*, q.q, q.seen, q.total, row_number() over (partition by r.label order by r.rank) c
          from with_ranked r join quotas q on q.label = r.label),
        rest as (select id, row_number() over (order by seen, c) f from placed where c > q)
        select p.id, p.label, p.rank from placed p left join rest on rest.id = p.id
        where p.total <= 50 or p.c <= p.q or rest.f <= 50 - (select sum(q) from quotas)""",
    "balance_min_class": f"""select id, label from (
        select id, trim(label) as label, row_number() over (partition by label order by {_hash(42)}, id) k from fx_rows where trim(description) <> '')
        where k <= (select min(n) from fx_counts)""",
    "balance_fixed": f"""
        ranked as (select id, r.label, n, row_number() over (partition by r.label order by {_hash(42)}, id) k
          from fx_rows r join fx_counts using (label))
        select id, label, null::bigint draw from ranked where n >= 130 and k <= 130
        union all
        select r.id, d.label, d.draw from (
          select label, draw, n, cast('0x' || substr(md5('42:' || label || ':' || cast(draw as varchar)), 1, 8) as bigint) % n + 1 k
          from fx_counts, (select unnest(range(1, 131)) draw) where n < 130) d
        join ranked r on r.label = d.label and r.k = d.k""",
    "balance_intelligent": f"""
        o as (select *, row_number() over (order by n, label) pos, sum(n) over (order by n, label) cum from fx_counts),
        w as (select *, pos <= 4 and cum < 400 whole from o),
        s as (select *, sum(case when whole then n else 0 end) over () taken,
            sum(case when whole then 0 else 1 end) over () others,
            sum(case when whole then 0 else 1 end) over (order by pos) place from w),
        q as (select label, case when whole then n
            else least(n, (400 - taken) // others + case when place <= (400 - taken) % others then 1 else 0 end) end q from s)
        select id, r.label from (
          select id, label, row_number() over (partition by label order by {_hash(42)}, id) k from fx_rows) r
        join q on q.label = r.label where k <= q""",
    "balanced_usable": """select cast(sum(n) as bigint) valid_rows, count(*) classes, sum(n) >= 500 and count(*) = 4 usable from fx_counts""",
    "class_counts": "select label, n as rows from fx_counts",
    "kfold": f"select id, ntile(5) over (order by {_hash(42)}, id) - 1 fold from fx_rows",
    "stratified_kfold": f"select id, source, ntile(5) over (partition by source order by {_hash(42)}, id) - 1 fold from fx_rows",
    # selection
    "uncertainty_sampling": f"""select p.id, p.description, p.label, {r6('p.uncertainty_score', 'uncertainty_score')}, u.rank
        from fx_unc u join fx_pool p on p.id = u.id where u.rank <= 100""",
    "committee_vote": f"""
        select v.id, votes, {r6('vote_entropy', 'vote_entropy')}, row_number() over (order by votes desc, vote_entropy desc, v.id) as rank, label
        from fx_votes v join fx_pool p on p.id = v.id where not is_labelled and description <> ''
        order by rank limit 60""",
    "committee_js": f"""
        select j.id, {r6('js', 'js')}, {r6('mean_entropy', 'mean_entropy')},
          row_number() over (order by js desc, mean_entropy desc, j.id) as rank, description
        from fx_js j join fx_pool p on p.id = j.id where not is_labelled and description <> ''
        order by rank limit 60""",
    "committee_scores": f"""select id, {r6('js', 'js')}, {r6('mean_entropy', 'mean_entropy')},
        {r6('normalized_entropy', 'normalized_entropy')} from fx_js""",
    "nearest_to_centroid": """
        long as (select vec_id id, label as cluster, unnest(range(1, 65)) i, cast(unnest(embedding) as double) x from embeddings),
        centre as (select cluster, i, avg(x) x from long group by all),
        far as (select l.cluster, l.id, round(sqrt(sum((l.x - c.x) * (l.x - c.x))), 6) distance
          from long l join centre c on c.cluster = l.cluster and c.i = l.i group by all)
        select cast(cluster as bigint) as cluster, id, distance + 0.0 as distance from (
          select *, row_number() over (partition by cluster order by distance, id) k from far) where k = 1""",
    "diversity_sampling": _diversity_sql(50),
    # scoring
    "class_weights": f"""
        select label, cast(code as bigint) code, round(total / coalesce(n, 1), 6) + 0.0 weight from (
          select unnest(['de','en','es','fr','it']) label, unnest(range(0, 5)) code) l
        left join fx_counts using (label), (select count(*) total from fx_rows)""",
    "train_classifier": f"""
        select p.label, ({LABELS_SQL})[list_position(probs, list_max(probs))] predicted_label, count(*) as rows
        from fx_pool p join {_bayes_sql(256)} s on s.id = p.id
        where not p.is_labelled and p.description <> '' and p.label <> '' group by 1, 2""",
    "model_predict": f"""
        select p.id, p.is_labelled,
          case when s.id is null then p.model_prediction else cast(list_position(probs, list_max(probs)) - 1 as varchar) end model_prediction,
          round(case when s.id is null then p.uncertainty_score else 1 - list_max(probs) end, 6) + 0.0 uncertainty_score
        from fx_pool p left join {_bayes_sql(256)} s on s.id = p.id and not p.is_labelled and p.description <> ''""",
    "predict_many": f"""
        select r.id, r.label, list_position(probs, list_max(probs)) - 1 predicted_class,
          ({LABELS_SQL})[list_position(probs, list_max(probs))] predicted_label, {r6('list_max(probs)', 'confidence')}
        from fx_rows r join {_bayes_sql(256)} s on s.id = r.id""",
    "train_logistic": _softmax_sql(
        f"""select p.label, {_chosen()} predicted_label, count(*) as rows from fx_pool p join sm using (id)
        where not p.is_labelled and p.description <> '' and p.label <> '' group by 1, 2""",
        1024,
        8,
    ),
    "logistic_weights": _softmax_sql(f"select b as bucket, label, {r6('w', 'weight')} from WEIGHTS", 1024, 8),
    "model_predict_logistic": _softmax_sql(
        """select p.id, p.is_labelled,
          case when sm.id is null then p.model_prediction else cast(list_position(probs, list_max(probs)) - 1 as varchar) end model_prediction,
          round(case when sm.id is null then p.uncertainty_score else 1 - list_max(probs) end, 6) + 0.0 uncertainty_score
        from fx_pool p left join sm on sm.id = p.id and not p.is_labelled and p.description <> ''""",
        1024,
        8,
    ),
    "predict_many_logistic": _softmax_sql(
        f"""select r.id, r.label, list_position(probs, list_max(probs)) - 1 predicted_class, {_chosen()} predicted_label,
          {r6('list_max(probs)', 'confidence')} from fx_rows r join sm using (id)""",
        1024,
        8,
    ),
    "active_learning_loop": _loop_sql(50, 3, 1024),
    "committee_predict": f"""
        select p.id, cast(member as bigint) as member, list_position(probs, list_max(probs)) - 1 predicted_class, {r6('list_max(probs)', 'confidence')}
        from fx_pool p join (
          select 0 as member, id, probs from {_bayes_sql(256)} union all select 1, id, probs from {_bayes_sql(64)}) s on s.id = p.id
        where not p.is_labelled""",
    "embed_text": """
        w as materialized (
          select id, md5(w) h from (
            select id, unnest(string_split_regex(lower(description), '[ \\t\\n\\r]+')) w from fx_rows where description <> '')
          where w <> ''),
        t as materialized (
          select id, ('0x' || substr(h, 1, 6))::bigint % 65536 cell, ('0x' || substr(h, 7, 6))::bigint % 256 dim,
            1 - 2 * (('0x' || substr(h, 13, 1))::bigint % 2) sign from w),
        d as (select cell, count(distinct id) df from t group by cell),
        v as (
          select id, dim, cast(sum(sign * cast(round(1e6 * ln(((select count(*) from fx_rows where description <> '') + 1) / (df + 1))) as bigint)) as double) x
          from t join d using (cell) group by id, dim having x <> 0)
        select id, dim, round(x / sqrt(sum(x * x) over (partition by id)), 6) + 0.0 as value from v""",
    "centroid_predict": f"""
        known as (select e.vec_id id, list_position({LABELS_SQL}, p.label) - 1 code, p.is_labelled, e.embedding
          from embeddings e join fx_pool p on p.id = e.vec_id),
        long as (select id, code, is_labelled, unnest(range(1, 65)) i, cast(unnest(embedding) as double) x from known),
        centre as (select code, i, avg(x) x from long where is_labelled group by all),
        near as (select l.id, c.code, exp(-sqrt(sum((l.x - c.x) * (l.x - c.x)))) e
          from long l join centre c on c.i = l.i group by all)
        select id, cast(arg_max(code, e) as bigint) predicted_class, ({LABELS_SQL})[arg_max(code, e) + 1] predicted_label,
          {r6('max(e) / sum(e)', 'confidence')} from near group by id""",
    # evaluation
    "accuracy": f"select {r6('avg(ok::int)', 'accuracy')}, count(*) total from fx_pred where member = 0 and description <> '' and label <> ''",
    "evaluate_rows": "select id, cast(member as bigint) as member, label, predicted_label, ok is_correct from fx_pred",
    "evaluate_summary": f"""select count(*) total, cast(sum(ok::int) as bigint) correct, {r6('avg(ok::int)', 'accuracy')},
        {r6('avg(confidence)', 'mean_confidence')}, {r6('stddev_samp(confidence)', 'confidence_std')} from fx_pred where member = 0""",
    "per_class_accuracy": f"select label, {r6('avg(ok::int)', 'accuracy')}, count(*) total from fx_pred group by label",
    "class_report": f"""select label, {r6('prec', 'precision')}, {r6('rec', 'recall')}, {r6('f1', 'f1')},
        cast(support as bigint) support from fx_report_f1""",
    "macro_f1": f"select {r6('avg(f1)', 'macro_f1')} from fx_report_f1",
    "recall_map": f"select 'recall_' || lower(label) as key, {r6('rec', 'recall')} from fx_report",
    "pool_mean_uncertainty": f"select {r6('avg(uncertainty_score)', 'avg_uncertainty_pool')} from fx_pool",
    "batch_mean_uncertainty": f"""select {r6('avg(uncertainty_score)', 'selected_samples_avg_uncertainty')} from fx_pool
        where id in (select id from fx_unc where rank <= 100)""",
    "test_mean_uncertainty": f"select {r6('avg(1 - list_max(probs))', 'avg_uncertainty')} from fx_pred where member = 0",
    "cross_validate": f"""select sfold fold, {r6('avg(ok::int)', 'accuracy')}, count(*) test_size,
        {r6('avg(confidence)', 'mean_confidence')} from fx_folds group by sfold""",
    "cv_summary": f"""select {r6('avg(a)', 'mean_accuracy')}, {r6('stddev_pop(a)', 'std_accuracy')}
        from (select avg(ok::int) a from fx_folds group by fold)""",
    "compare_models": f"""select cast(member as bigint) as member, {r6('avg(ok::int)', 'accuracy')}, cast(sum(ok::int) as bigint) correct,
        count(*) total, {r6('avg(confidence)', 'mean_confidence')}, {r6('stddev_pop(confidence)', 'confidence_std')},
        rank() over (order by avg(ok::int) desc) as rank from fx_pred group by member""",
    "compare_models_by_class": f"""select cast(member as bigint) as member, label, {r6('avg(ok::int)', 'accuracy')}, count(*) total
        from fx_pred group by all""",
    "errors_by_true": f"""select label, count(*) total, count(*) filter (not ok) errors, {r6('avg((not ok)::int)', 'error_rate')},
        {r6('avg(ok::int)', 'accuracy')} from fx_pred group by label""",
    "errors_by_predicted": f"""select predicted_label, count(*) errors, {r6('count(*) / sum(count(*)) over ()', 'error_share')}
        from fx_pred where not ok group by predicted_label""",
    "confusion_top": """select label, predicted_label, count(*) errors from fx_pred where not ok
        group by all order by errors desc, label, predicted_label limit 10""",
    "confidence_by_outcome": f"""select ok is_correct, {r6('avg(confidence)', 'mean')}, {r6('stddev_pop(confidence)', 'std')},
        {r6('min(confidence)', 'min')}, {r6('max(confidence)', 'max')} from fx_pred group by ok""",
    "high_conf_errors": f"""select id, cast(member as bigint) as member, label, predicted_label, {r6('confidence', 'confidence')}
        from fx_pred where not ok and confidence >= 0.8""",
    "error_examples": f"""
        top as (select label, predicted_label, count(*) pattern_count, min(id) id from fx_pred where not ok and member = 0
          group by all order by 3 desc, 1, 2 limit 5)
        select t.label, t.predicted_label, pattern_count, t.id, {r6('confidence', 'confidence')},
          case when length(description) > 200 then substr(description, 1, 200) || '...' else description end as text
        from top t join fx_pred p on p.id = t.id and p.member = 0""",
    "error_rows": f"""select id, label, predicted_label, {r6('confidence', 'confidence')}, description
        from fx_pred where not ok and member = 0""",
    "evaluation_summary": f"""
        select {r6('avg(ok::int)', 'accuracy')}, {r6('avg((not ok)::int)', 'error_rate')},
          (select cast(member as bigint) from fx_pred group by member order by avg(ok::int) desc, member limit 1) best_model,
          (select round(avg(a), 6) + 0.0 from (select avg(ok::int) a from fx_folds group by sfold)) cv_mean_accuracy,
          (select round(stddev_pop(a), 6) + 0.0 from (select avg(ok::int) a from fx_folds group by sfold)) cv_std_accuracy
        from fx_pred where member = 0""",
    # results log
    "split_runs": "select id, run, method, cast(iteration_no as bigint) iteration_no from fx_runs",
    "run_method": """select run, coalesce(arg_min(trim(method), id) filter (upper(trim(method)) <> 'BASE'
        and trim(method) <> 'base_classifier' and trim(method) <> ''), 'unknown') as method from fx_runs group by run""",
    "run_header": """
        select run, arg_max(data_size, id) filter (data_size is not null) pool_size,
          arg_max(train_data_size, id) filter (train_data_size is not null) train_data_size,
          coalesce(arg_max(n, id) filter (n is not null), cast(json_extract_string(arg_max(params, id), '$.N') as bigint)) n,
          arg_max(notes, id) stop_reason from fx_runs group by run""",
    "metric_series": f"""select run, cast(iteration_no as bigint) iteration_no, metric,
        round(case when metric = 'accuracy' then value * 100 else value end, 6) + 0.0 as value
        from fx_entries where value is not null and not starts_with(metric, 'recall_')""",
    "recall_series": f"""select run, cast(iteration_no as bigint) iteration_no,
        case metric when 'recall_full-time' then 'Full-Time' when 'recall_contract' then 'Contract' else 'Volunteer' end class_name,
        {r6('value', 'value')} from fx_entries where value is not null and starts_with(metric, 'recall_')""",
    "series_label": """
        select run, case when run = max(run) over () and method = 'random_sampling' and size >= 10000 then 'Full Size Labelling'
          when method = 'uncertainty_sampling' then 'Uncertainty Sampling' when method = 'diversity_sampling' then 'Diversity Sampling'
          when method = 'query_by_comitee' then 'Query by Committee' when method = 'random_sampling' then 'Random Sampling'
          else coalesce(method, 'unknown') end title
        from (select run, arg_min(method, id) filter (method <> 'BASE') as method, max(train_data_size) size from fx_runs group by run)""",
    "learning_curve": f"select method, train_data_size, {r6('accuracy', 'accuracy')}, {r6('macro_f1', 'macro_f1')} from fx_curve",
    "improvement_vs_random": f"""
        select c.method, {r6('avg((c.accuracy - b.accuracy) / nullif(b.accuracy, 0) * 100)', 'accuracy_improvement_pct')},
          {r6('avg((c.macro_f1 - b.macro_f1) / nullif(b.macro_f1, 0) * 100)', 'macro_f1_improvement_pct')},
          {r6('max((c.accuracy - b.accuracy) / nullif(b.accuracy, 0) * 100)', 'max_accuracy_improvement_pct')},
          {r6('max((c.macro_f1 - b.macro_f1) / nullif(b.macro_f1, 0) * 100)', 'max_macro_f1_improvement_pct')},
          count(*) common_sizes
        from fx_curve c join fx_base_curve b using (train_data_size) where c.method <> 'random_sampling' group by c.method""",
    "labels_to_target": f"select method, metric, {r6('target', 'target')}, labels from fx_reached",
    "data_savings": """
        saved as (select r.method, r.metric, (b.labels - r.labels) / b.labels * 100 pct from fx_reached r
          join fx_reached b on b.method = 'random_sampling' and b.metric = r.metric and b.target = r.target
          where r.method <> 'random_sampling' and r.labels > 0 and b.labels > 0)
        select m.method, round(coalesce(avg(pct) filter (metric = 'accuracy'), 0), 6) + 0.0 avg_accuracy_savings_pct,
          round(coalesce(avg(pct) filter (metric = 'macro_f1'), 0), 6) + 0.0 avg_macro_f1_savings_pct,
          round(coalesce(max(pct) filter (metric = 'accuracy'), 0), 6) + 0.0 max_accuracy_savings_pct,
          round(coalesce(max(pct) filter (metric = 'macro_f1'), 0), 6) + 0.0 max_macro_f1_savings_pct
        from (select distinct method from fx_curve where method <> 'random_sampling') m left join saved s on s.method = m.method
        group by m.method""",
    "gap_to_full": f"""select method, {r6('accuracy', 'final_accuracy')}, {r6('macro_f1', 'final_macro_f1')},
        train_data_size final_train_size, {r6('(0.716::double - accuracy) / 0.716::double * 100', 'accuracy_gap_pct')},
        {r6('(0.725::double - macro_f1) / 0.725::double * 100', 'macro_f1_gap_pct')},
        {r6('train_data_size / 1000 * 100', 'size_vs_full_pct')} from fx_final""",
    "final_stats": f"""
        select metric, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')}, {r6('min(value)', 'min')}, {r6('max(value)', 'max')},
          count(*) methods from (select method, 'accuracy' metric, accuracy as value from fx_final
            union all select method, 'macro_f1', macro_f1 from fx_final) group by metric""",
    "final_vs_random": f"""
        select f.method, {r6('f.accuracy - b.accuracy', 'accuracy_difference')}, {r6('f.macro_f1 - b.macro_f1', 'macro_f1_difference')},
          {r6('(f.accuracy - b.accuracy) / b.accuracy * 100', 'accuracy_improvement_pct')},
          {r6('(f.macro_f1 - b.macro_f1) / b.macro_f1 * 100', 'macro_f1_improvement_pct')}
        from fx_final f, (select * from fx_final where method = 'random_sampling') b where f.method <> 'random_sampling'""",
    "paired_t_test": f"""select method, pairs, {r6('t_statistic', 't_statistic')}, {r6(P_PAIRED, 'p_value')},
        {r6('mean_diff', 'mean_diff')}, {r6('mean_diff_pct', 'mean_diff_pct')} from fx_pair_stats""",
    "cohens_d": f"""select method, {r6('cohens_d', 'cohens_d')}, {r6('mean_diff', 'mean_diff')}, {r6('mean_diff_pct', 'mean_diff_pct')},
        {r6('method_final_f1', 'method_final_f1')}, {r6('random_final_f1', 'random_final_f1')} from fx_pair_stats""",
    "performance_table": f"""
        select method, {r6('mean_diff', 'mean_diff')}, {r6('mean_diff_pct', 'mean_diff_pct')}, {r6('p_value', 'p_value')},
          {r6('cohens_d', 'cohens_d')}, {STARS} stars from (select *, {P_PAIRED} p_value from fx_pair_stats)""",
    "anova_methods": f"""
        g as (select method, macro_f1 x, avg(macro_f1) over (partition by method) m, avg(macro_f1) over () grand,
          count(*) over (partition by method) c from fx_f1),
        s as (select cast(count(distinct method) as bigint) n_methods, cast(count(distinct method) - 1 as double) d1,
          cast(count(*) - count(distinct method) as double) d2,
          (sum((m - grand) * (m - grand)) / (count(distinct method) - 1))
            / (sum((x - m) * (x - m)) / (count(*) - count(distinct method))) f from g where c > 1)
        select n_methods, {r6('f', 'f_statistic')}, {r6(_tail('f', 'd1', 'd2'), 'p_value')} from s""",
    "iterations_to_target": f"""
        hit as (select method, cast(arg_min(iteration_no, id) as bigint) it from fx_f1
          where macro_f1 >= (select max(macro_f1) from fx_f1) * 0.95::double group by method)
        select h.method, h.it target_iter, b.it random_iter, round((b.it - h.it) / nullif(b.it, 0) * 100, 6) + 0.0 iteration_reduction_pct,
          round(b.it / nullif(h.it, 0), 6) + 0.0 efficiency_ratio
        from hit h, (select it from hit where method = 'random_sampling') b""",
    "curve_auc": f"""
        pairs as (select method, id, train_data_size, iteration_no x, macro_f1 y, lag(iteration_no) over w px, lag(macro_f1) over w py
          from fx_f1 window w as (partition by method order by id))
        select method, {r6('sum((x - px) * (y + py) / 2)', 'auc')}, arg_max(train_data_size, id) total_labels,
          {r6('sum((x - px) * (y + py) / 2) / arg_max(train_data_size, id) * 1000', 'learning_efficiency')}
        from pairs group by method having count(*) > 1""",
    "convergence": f"""
        hit as (select method, lv as level, cast(iteration_no as bigint) iteration, train_data_size labels, macro_f1,
            row_number() over (partition by method, lv order by id) k
          from fx_f1, (select unnest([0.7::double, 0.8::double, 0.9::double, 0.95::double]) lv)
          where macro_f1 >= (select max(macro_f1) from fx_f1) * lv)
        select method, {r6('level', 'level')}, iteration, labels, {r6('macro_f1', 'macro_f1')} from hit where k = 1""",
    "label_efficiency": f"""select method, {r6('macro_f1', 'macro_f1')}, labels, {r6('macro_f1 / labels * 1000', 'label_efficiency')}
        from fx_last""",
    "early_performance": f"""select method, n // 4 early_iteration, {r6('macro_f1', 'early_performance')} from (
        select method, macro_f1, row_number() over (partition by method order by id) - 1 k, count(*) over (partition by method) n
        from fx_f1) where n >= 4 and k = n // 4""",
    "cost_benefit": f"""
        select f.method, {r6('f.macro_f1 - b.macro_f1', 'performance_gain')},
          {r6('(f.macro_f1 - b.macro_f1) / b.macro_f1 * 100', 'performance_gain_pct')}, b.labels - f.labels label_savings,
          {r6('(b.labels - f.labels) / b.labels * 100', 'label_savings_pct')},
          {r6('(f.macro_f1 / f.labels) / (b.macro_f1 / b.labels)', 'efficiency_ratio')},
          {r6('f.macro_f1', 'method_f1')}, {r6('b.macro_f1', 'random_f1')}, f.labels method_labels, b.labels random_labels
        from fx_last f, (select * from fx_last where method = 'random_sampling') b where f.method <> 'random_sampling'""",
    "best_by_combined": f"""select method, {r6('macro_f1', 'final_f1')}, {r6('accuracy', 'final_accuracy')},
        cast(iteration_no as bigint) final_iteration, train_data_size final_labels, {r6('combined', 'combined_score')} from fx_best_combined""",
    "objectives": f"""
        b as (select * from fx_best_combined where method not like '%random%' order by combined desc, first_id limit 1),
        r as (select * from fx_best_combined where method like '%random%' order by first_id limit 1),
        nb as (select c.train_data_size x from fx_combined c, b, r where c.method = b.method and c.combined >= r.combined * 0.95::double
          order by c.iteration_no, c.id limit 1),
        nr as (select c.train_data_size x from fx_combined c, b, r where c.method = r.method and c.combined >= b.combined * 0.95::double
          order by c.iteration_no, c.id limit 1)
        select b.method best_method, r.method random_method, {r6('b.macro_f1', 'best_final_f1')}, {r6('b.accuracy', 'best_final_accuracy')},
          {r6('b.combined', 'best_combined_score')}, {r6('r.macro_f1', 'random_final_f1')}, {r6('r.accuracy', 'random_final_accuracy')},
          {r6('r.combined', 'random_combined_score')}, {r6('(b.combined - r.combined) / r.combined * 100', 'performance_difference_pct')},
          coalesce((select x from nb), b.train_data_size) data_for_target, r.train_data_size random_final_labels,
          {r6('(r.train_data_size - coalesce((select x from nb), b.train_data_size)) / r.train_data_size * 100', 'data_savings_pct')},
          coalesce((select x from nr), r.train_data_size) data_for_random_target, b.train_data_size best_final_labels,
          {r6('coalesce((select x from nr), r.train_data_size) / b.train_data_size', 'data_ratio')}
        from b, r""",
    "best_by_f1": "select method, "
    + "final_labels, "
    + ", ".join(
        r6(c, c)
        for c in [
            "final_f1", "final_accuracy", "avg_uncertainty_pool", "selected_samples_avg_uncertainty", "recall_contract",
            "recall_internship", "recall_volunteer", "recall_temporary", "avg_minority_recall",
        ]
    )
    + " from fx_best",
    "method_extremes": f"""
        t as (select * from fx_best_long where method not like '%random%')
        select metric, (arg_max(method, (value, -first_id))) best_method, {r6('max(value)', 'best_value')},
          (arg_min(method, (value, first_id))) worst_method, {r6('min(value)', 'worst_value')} from t group by metric""",
    "best_vs_random": f"""
        r as (select * from fx_best where method like '%random%' order by first_id limit 1),
        g as (select l.*, b.value random_value, r.final_labels base_labels,
            coalesce((l.value - b.value) / nullif(b.value, 0) * 100, 0) pct,
            row_number() over (partition by l.metric order by coalesce((l.value - b.value) / nullif(b.value, 0) * 100, 0) desc, l.first_id) k
          from fx_best_long l, r, fx_best_long b
          where b.method = r.method and b.metric = l.metric and l.method not like '%random%')
        select metric, {r6('random_value', 'random_value')}, case when pct > 0 then method end best_method,
          round(case when pct > 0 then value end, 6) + 0.0 best_value, round(case when pct > 0 then pct end, 6) + 0.0 improvement_pct,
          round(case when pct > 0 then base_labels / final_labels end, 6) + 0.0 label_ratio from g where k = 1""",
    "minority_vs_random": f"""
        l as (unpivot (select method, first_id, coalesce(recall_contract, 0) recall_contract, coalesce(recall_internship, 0) recall_internship,
            coalesce(recall_volunteer, 0) recall_volunteer, coalesce(recall_temporary, 0) recall_temporary from fx_best)
          on recall_contract, recall_internship, recall_volunteer, recall_temporary into name class_recall value v),
        r as (select method from fx_best where method like '%random%' order by first_id limit 1),
        g as (select l.class_recall, l.method, l.v, b.v rv, l.v - b.v gain,
            row_number() over (partition by l.class_recall order by l.v - b.v desc, l.first_id) k
          from l join l b on b.class_recall = l.class_recall join r on b.method = r.method where l.method not like '%random%')
        select class_recall, {r6('rv', 'random_value')}, case when gain > 0 then method end best_method,
          round(case when gain > 0 then v else 0 end, 6) + 0.0 best_value, round(greatest(gain, 0), 6) + 0.0 improvement,
          round(case when rv > 0 then greatest(gain, 0) / rv * 100 else 0 end, 6) + 0.0 improvement_pct from g where k = 1""",
    "overall_winner": f"""
        w as (select *, (final_accuracy + final_f1 + avg_minority_recall) / 3 score from fx_best where method not like '%random%'
          order by score desc, first_id limit 1),
        t as (select metric, arg_max(method, (value, -first_id)) m from fx_best_long where method not like '%random%' group by metric)
        select method, {r6('score', 'score')}, method = (select m from t where metric = 'final_f1') leads_final_f1,
          method = (select m from t where metric = 'final_accuracy') leads_final_accuracy,
          method = (select m from t where metric = 'avg_minority_recall') leads_avg_minority_recall from w""",
    # loop control
    "stop_plateau": "select id, run, cast(iteration_no as bigint) iteration_no, streak, plateau from fx_plateau",
    "stop_budget": """
        select id, run, reason <> 'continue' stop, reason from (select id, run, case when plateau then 'uncertainty_plateau'
          when accuracy >= 0.85 then 'accuracy_threshold (0.85)' when train_data_size >= 12000 then 'label_budget'
          when iteration_no >= 5 then 'max_iterations_reached (5)' else 'continue' end reason from fx_plateau)""",
    "stop_classic": f"""
        select id, run, {r6('previous_accuracy', 'previous_accuracy')}, {r6('gain', 'gain')}, reason is not null stop, reason from (
          select *, case when avg_uncertainty_pool is null then 'pool_empty' when avg_uncertainty_pool < 0.1 then 'T_threshold_reached'
            when iteration_no >= 7 then 'max_iterations_reached' when accuracy >= 0.7 then 'success_rate_reached'
            when gain > 0 and gain < 0.05 then 'improvement_below_I' end reason
          from (select *, accuracy - previous_accuracy gain from fx_steps))""",
    "stop_min_gain": f"""
        select id, run, {r6('gain', 'gain')}, reason is not null stop, reason from (
          select *, case when previous_accuracy is null then null when gain < 0.001 then 'min_improvement_not_met'
            when data_size - train_data_size = 0 then 'pool_empty' end reason
          from (select *, accuracy - previous_accuracy gain from fx_steps))""",
    "iteration_report": f"""
        select id, run, cast(iteration_no as bigint) iteration,
          case when method in {BASE} then 0 else train_data_size - coalesce(size_before, 0) end n_labeled,
          {r6('previous_accuracy', 'previous_accuracy')}, {r6('accuracy', 'new_accuracy')},
          notes not in ('continue', 'base_classifier') stop_condition, notes stop_reason from fx_steps""",
    # other
    "column_similarity": """
        parts as (select unnest(['a', 'b', 'c']) as column_name, embedding[1:16]::double[] t,
          unnest([embedding[17:32]::double[], embedding[33:48]::double[], embedding[49:64]::double[]]) o from embeddings)
        select column_name, round(avg(list_cosine_similarity(t, o)), 6) + 0.0 as similarity from parts group by column_name""",
}
_RAW["store_compacted"] = _RAW["store_updates"]
_RAW["write_json"] = _RAW["compare_models"]


def _build(body: str) -> str:
    """Bodies that open with their own common table expressions continue the list of views."""
    text = body.strip()
    if re.match(r"^\w+ as (materialized )?\(", text):
        views = _needed(text, [])
        listed = [f"{v} as materialized ({VIEWS[v]})" for v in views]
        return "with " + ",\n".join([*listed, ""]) + text if listed else "with " + text
    return sql(text)


ORACLES = {name: _build(body) for name, body in _RAW.items()}
