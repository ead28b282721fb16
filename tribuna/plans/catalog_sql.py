"""The same queries in SQL, as an independent statement of what they mean."""

from __future__ import annotations

W = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


EMPTY = "''"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def clean(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '{W}+', ' ', 'g')")


def title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '\p{{L}}+|[^\p{{L}}]+'), lambda w: (case when w[1:1] = 'ß' then 'Ss' else upper(w[1:1]) end) || w[2:]), '')"


def fold(x: str) -> str:
    for a, b in ("ªa", "ºo", "¹1", "²2", "³3"):
        x = f"replace({x}, '{a}', '{b}')"
    return rf"strip_accents(regexp_replace(replace({x}, chr(160), ' '), '[\x{{a8}}\x{{af}}\x{{b4}}\x{{b8}}]', ' ', 'g'))"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x)}), '[^a-z0-9 ]', ' ', 'g'))"


def tokens(x: str, least: int = 1) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: length(t) >= {least}))"


def marker(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)^{W}*(?:o|a){W}+', '')"
    x = f"regexp_replace({x}, '(?i)^{W}*(?:sr\\.?|sra\\.?){W}+', '')"
    x = f"regexp_replace({x}, '{W}*\\([^)]*\\){W}*$', '')"
    x = f"regexp_replace({x}, '(?i)^{W}*(?:deputado|deputada|senador|senadora|ministro|ministra|senhor|senhora|relator|relatora){W}+', '')"
    return f"trim({x}, ' -:')"


def party(x: str) -> str:
    # Fixed value: the form of an office with its party.
    found = rf"regexp_extract({x}, '(?i)(?:Deputad[ao]|Senador[a]?){W}*\({W}*([^-]+?){W}*-{W}*[A-Za-z]{{2}}{W}*\)', 1)"
    return f"coalesce({strip(f'upper(nullif({found}, {EMPTY}))')}, 'SOCIEDADE/OUTROS')"


LATEST = "hs as (select id, max(transcricao) t, any_value(metadados) metadados from publichearingbr_lds group by id)"
EACH = "(select *, unnest(range(coalesce(len(metadados.envolvidos), 0))) i from {h})"


def people(h: str) -> str:
    return f"""people as (select id id_audiencia, {clean('metadados.assunto')} assunto_audiencia, i part_ord, {title(clean('e.nome'))} nome, {clean('e.cargo')} cargo,
      {clean("array_to_string(list_filter(e.opinioes, lambda o: o is not null), ' | ')")} opinioes_resumo
      from (select *, metadados.envolvidos[i + 1] e from {EACH.format(h=h)}))"""


def opinions(h: str) -> str:
    return f"""ops as (select * from (select id id_audiencia, coalesce(metadados.assunto, '') assunto_audiencia, i part_ord, j op_ord, {title(strip("coalesce(e.nome, '')"))} nome, {strip("coalesce(e.cargo, '')")} cargo,
      {strip("coalesce(e.opinioes[j + 1], '')")} opiniao_limpa, {party(strip("coalesce(e.cargo, '')"))} filiacao_rede
      from (select *, unnest(range(coalesce(len(e.opinioes), 0))) j from (select *, metadados.envolvidos[i + 1] e from {EACH.format(h=h)}))) where opiniao_limpa <> '')"""


# Letters outside ASCII as x and blanks outside ASCII as blanks: same length, and \b and \s mean what they mean in Unicode.
SHADOW = rf"regexp_replace(regexp_replace(t, '[\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]', ' ', 'g'), '[\x{{aa}}\x{{b5}}\x{{ba}}\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{2c1}}\x{{370}}-\x{{1fff}}\x{{3040}}-\x{{9fff}}\x{{ac00}}-\x{{d7a3}}]', 'x', 'g')"
# Fixed value: the form of a marker.
RE = r"(?i)\b(?:O\s+SR\.?|A\s+SRA\.?)\s+[^()\n-]{2,100}(?:\([^\n)]{1,140}\))?\s*-\s*"
MARKERS = f"""{LATEST},
cut as (select id, t, regexp_extract_all(s, '{RE}') ms, regexp_split_to_array(s, '{RE}') gs from (select id, t, {SHADOW} s from hs where {strip("coalesce(t, '')")} <> '')),
placed as (select id, t, cast(list_sum(list_transform(gs[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) as bigint) inicio, length(ms[i + 1]) l from (select *, unnest(range(len(ms))) i from cut)),
marks as (select id id_audiencia, length(t) tamanho, inicio, inicio + l fim, regexp_replace(substring(t, inicio + 1, l), '{W}*-{W}*$', '') marcador from placed),
found as (select *, {marker('marcador')} orador_marcador from marks)"""
KNOWN = f"known as (select distinct conhecido, {tokens('conhecido', 3)} palavras from (select {norm('nome')} conhecido from people) where conhecido <> '' and len({tokens('conhecido', 3)}) > 0)"
ACCEPTED = f"""{MARKERS}, {people('hs')}, {KNOWN},
seen as (select distinct {norm('orador_marcador')} norma from found),
good as (select norma from seen where norma in ('presidente', 'vice presidente', 'relator', 'relatora', 'secretario', 'secretaria') or exists (select 1 from known where list_has_all({tokens('norma')}, palavras)))"""
TURNS = f"""{ACCEPTED},
spans as (select *, coalesce(lead(inicio) over (partition by id_audiencia order by inicio), tamanho) ate from found where {norm('orador_marcador')} in (select norma from good)),
turns as (select *, row_number() over (partition by id_audiencia order by inicio_char) - 1 ordem_turno from (
  select id_audiencia, orador_marcador, {clean('substring(t, cast(fim + 1 as bigint), cast(ate - fim as bigint))')} texto_turno, inicio inicio_char, ate fim_char from spans join hs on hs.id = id_audiencia) where texto_turno <> ''),
mine as (select turns.*, part_ord, nome from turns join people using (id_audiencia) where len({tokens(norm('nome'), 3)}) > 0 and list_has_all({tokens(norm('orador_marcador'))}, {tokens(norm('nome'), 3)}))"""
PROPS = "one as (select id_audiencia, max(proposicoes_audiencia) proposicoes_audiencia from df_props group by 1)"
LISTED = f"list_filter(list_transform(string_split(proposicoes_audiencia, '|'), lambda p: {strip('p')}), lambda p: p <> '')"
OUTER = f"unnest(case when proposicoes_audiencia is null or len({LISTED}) = 0 then [null] else {LISTED} end)"
PAIRED = f"{LATEST}, {opinions('hs')}, {PROPS}, paired as (select ops.*, {OUTER} proposicao_alvo from ops join one using (id_audiencia))"
VALID = "v as (select * from base_posturas_classificadas where postura_final in ('A FAVOR', 'CONTRA', 'NEUTRO'))"
EDGES = f"""{VALID},
edges as (select a.nome src, b.nome dst,
  count(*) filter (where a.postura_final <> 'NEUTRO' and a.postura_final = b.postura_final) concordancia,
  count(*) filter (where a.postura_final <> 'NEUTRO' and b.postura_final <> 'NEUTRO' and a.postura_final <> b.postura_final) discordancia,
  count(*) filter (where a.postura_final = 'NEUTRO' or b.postura_final = 'NEUTRO') neutro
  from v a join v b on a.proposicao_alvo = b.proposicao_alvo and a.nome < b.nome group by 1, 2)"""
COLOUR = "case {0} when 'PT' then '#CC0000' when 'PL' then '#222299' when 'NOVO' then '#FF6600' when 'PSOL' then '#FFCC00' when 'MDB' then '#009933' when 'SOCIEDADE/OUTROS' then '#888888' else '#AAAAAA' end"
NODES = f"""{VALID}, nodes as (select nome, x.f "group", {COLOUR.format('x.f')} color, nome || chr(10) || '(' || coalesce(x.f, 'nan') || ')' label, nome || ' - ' || coalesce(x.f, 'nan') title, cast(15 as bigint) size
  from (select nome, arg_max(struct_pack(f := filiacao_rede), linha_id) x from v where nome is not null group by nome))"""
CLASSES = """c as (select proposicao_alvo p, nome, count(*) filter (where postura_final = 'A FAVOR') f, count(*) filter (where postura_final = 'CONTRA') c, count(*) filter (where postura_final = 'NEUTRO') z
  from base_posturas_classificadas where postura_final in ('A FAVOR', 'CONTRA', 'NEUTRO') and proposicao_alvo is not null and nome is not null group by 1, 2),
said as (select nome, string_agg(p || chr(31) || f || ',' || c || ',' || z, chr(30) order by p) k from c group by nome),
cl as (select k, min(nome) de, count(*) n from said group by k)"""
NAMES = "names as (select distinct e.nome nome, e.cargo cargo from (select unnest(metadados.envolvidos) e from publichearingbr_lds))"
FILE = "lower(coalesce(assunto_audiencia, '')) like '%debate%' and lower(coalesce(assunto_audiencia, '')) like '%sobre%'"
REST = "replace(s, 'PROP:', '')"
PATTERN = "regexp_matches(coalesce(assunto_audiencia, ''), 'vacina|fila de', 'i')"

SQL: dict[str, str] = {
    "scan_project": "select turno_id, id_audiencia, ordem_turno ordem from df_turnos",
    "preview_head": "select distinct turno_id, orador_marcador from df_turnos order by turno_id limit 20",
    "constant_columns": "select distinct nome, cast(15 as bigint) size, cast(0 as bigint) concordancia from base_posturas_classificadas where nome is not null",
    "json_flatten_one": f"with {people('publichearingbr_lds')} select * from people",
    "json_flatten_two": f"with {opinions('publichearingbr_lds')} select * from ops",
    "outer_explode": f"select id_audiencia, {OUTER} proposicao_alvo from df_props",
    "struct_flatten": "select id, metadados.assunto assunto, cast(coalesce(len(metadados.envolvidos), 0) as bigint) n from publichearingbr_lds",
    "filter_nonblank": f"select id, length(transcricao) n from publichearingbr_lds where {strip('transcricao')} <> ''",
    "filter_in": "select linha_id, postura_final from base_posturas_classificadas where postura_final in ('A FAVOR', 'CONTRA', 'NEUTRO')",
    "filter_contains_all": f"select linha_id, assunto_audiencia from base_posturas_classificadas where {FILE}",
    "filter_regex_ci": f"select linha_id, assunto_audiencia from base_posturas_classificadas where {PATTERN}",
    "filter_quantifiers": "select id, len(list_filter(metadados.envolvidos, lambda e: e.cargo is not null)) > 0 algum, len(list_filter(metadados.envolvidos, lambda e: e.cargo is not null)) = len(metadados.envolvidos) todos from publichearingbr_lds where metadados.envolvidos is not null",
    "clean_text": f"select id, {clean('transcricao')} limpo from publichearingbr_lds",
    "strip_text": f"with {NAMES} select distinct nome, {strip('nome')} aparado from names",
    "title_case": f"with {NAMES} select distinct nome, {title('nome')} titulo from names",
    "fold_accents": f"with {NAMES} select distinct nome, {fold('nome')} dobrado from names",
    "normalize_name": f"with {NAMES} select distinct nome, {norm('nome')} norma from names",
    "clean_marker": f"select m marcador, {marker('m')} nome from (select distinct 'O SR. DEPUTADO ' || orador_marcador || ' (PLUZ - SP) ' m from df_turnos)",
    "affiliation": f"with {NAMES} select distinct cargo, {party('cargo')} filiacao_rede from names",
    "stance_normalize": "select linha_id, r resposta, case when upper(r) like '%FAVOR%' then 'A FAVOR' when upper(r) like '%CONTRA%' then 'CONTRA' else 'NEUTRO' end postura from (select linha_id, lower(coalesce(postura_final, 'talvez')) || '. ' || case when linha_id % 2 = 0 then 'não a favor' else '' end r from base_posturas_classificadas)",
    "parse_prefixed_lines": f"select id_audiencia, i pos, l[i + 1] proposicao from (select id_audiencia, l, unnest(range(len(l))) i from (select id_audiencia, list_transform(list_filter(string_split({strip('x')}, chr(10)), lambda s: starts_with(s, 'PROP:')), lambda s: {strip(REST)}) l from (select id_audiencia, 'Claro!' || chr(10) || 'PROP: ' || replace(proposicoes_audiencia, ' | ', chr(10) || 'PROP: ') || chr(10) || ' PROP: recuada' || chr(10) || 'fim' x from df_props)))",
    "markers_positions": f"with {MARKERS} select id_audiencia, inicio, fim, marcador, orador_marcador from found",
    "known_name_semi": f"with {ACCEPTED} select norma from good",
    "token_containment_join": f"with {LATEST}, {people('hs')} select t.turno_id, part_ord, nome from (select distinct turno_id, id_audiencia, orador_marcador from df_turnos) t join people using (id_audiencia) where len({tokens(norm('nome'), 3)}) > 0 and list_has_all({tokens(norm('orador_marcador'))}, {tokens(norm('nome'), 3)})",
    "turns_numbered": f"with {TURNS} select id_audiencia, ordem_turno, orador_marcador, texto_turno, inicio_char, fim_char from turns",
    "turns_attributed": f"with {TURNS} select id_audiencia, part_ord, nome, ordem_turno, inicio_char, fim_char from mine",
    "turns_speaker_ordinal": f"with {TURNS} select id_audiencia, part_ord, row_number() over (partition by id_audiencia, part_ord order by inicio_char) - 1 ordem_turno, inicio_char from mine",
    "participants_without_turns": f"with {TURNS} select count(*) filter (where not exists (select 1 from mine m where m.id_audiencia = p.id_audiencia and m.part_ord = p.part_ord)) sem_turno, count(*) participantes from people p",
    "chunk_turns": f"""with recursive u as (select turno_id, any_value(texto_turno) t from df_turnos group by 1),
      s as (select turno_id, string_split(regexp_replace({strip('t')}, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)) l from u where {strip("coalesce(t, '')")} <> ''),
      r as (select turno_id, l, 1 i, l[1] now, 0 ch from s union all
        select turno_id, l, i + 1, case when length(now || ' ' || l[i + 1]) > 1000 then l[i + 1] else now || ' ' || l[i + 1] end, case when length(now || ' ' || l[i + 1]) > 1000 then ch + 1 else ch end from r where i < len(l))
      select turno_id, cast(ch as bigint) ordem_chunk, arg_max(now, i) chunks from r group by turno_id, ch""",
    "chunk_attributed": f"""with recursive {TURNS},
      s as (select id_audiencia, nome, ordem_turno, part_ord, string_split(regexp_replace({strip('texto_turno')}, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)) l from mine),
      r as (select *, 1 i, l[1] now, 0 ch from s union all
        select id_audiencia, nome, ordem_turno, part_ord, l, i + 1, case when length(now || ' ' || l[i + 1]) > 1000 then l[i + 1] else now || ' ' || l[i + 1] end, case when length(now || ' ' || l[i + 1]) > 1000 then ch + 1 else ch end from r where i < len(l)),
      k as (select id_audiencia, nome, ordem_turno, part_ord, ch, arg_max(now, i) chunk from r group by all)
      select id_audiencia, nome, ordem_turno, count(*) chunks, count(*) - 1 ultimo, cast(sum(length(chunk)) as bigint) caracteres from k group by 1, 2, 3""",
    "group_concat_ordered": f"with {LATEST}, {opinions('hs')} select id_audiencia, assunto_audiencia, chr(10) || '- ' || string_agg(opiniao_limpa, chr(10) || '- ' order by part_ord, op_ord) opinioes from ops group by 1, 2",
    "merge_inner": f"with {LATEST}, {opinions('hs')}, {PROPS} select id_audiencia, part_ord, op_ord, proposicoes_audiencia from ops join one using (id_audiencia)",
    "pair_opinions_propositions": f"with {PAIRED} select id_audiencia, part_ord, op_ord, proposicao_alvo from paired",
    "lookup_left_default": f"select distinct filiacao_rede, {COLOUR.format('filiacao_rede')} cor from base_posturas_classificadas",
    "distinct_pairs": "select distinct id_audiencia, assunto_audiencia from base_posturas_classificadas",
    "distinct_values": f"with {people('publichearingbr_lds')}, {KNOWN} select conhecido from known",
    "row_counts": "select count(*) linhas, count(proposicao_alvo) com_proposicao, count(distinct id_audiencia) audiencias from base_posturas_classificadas",
    "top10_propositions": 'select proposicao_alvo, count(*) "count" from base_posturas_classificadas where proposicao_alvo is not null group by 1 order by 2 desc, 1 limit 10',
    "top10_speakers": 'select nome, count(*) "count" from base_posturas_classificadas where nome is not null group by 1 order by 2 desc, 1 limit 10',
    "group_volume": 'select filiacao_rede, count(*) "count" from base_posturas_classificadas where filiacao_rede is not null group by 1',
    "crosstab_margins": "select case when grouping(filiacao_rede) = 1 then 'TOTAL_GERAL' else filiacao_rede end filiacao_rede, count(*) filter (where postura_final = 'A FAVOR') a_favor, count(*) filter (where postura_final = 'CONTRA') contra, count(*) filter (where postura_final = 'ERRO API') erro_api, count(*) filter (where postura_final = 'NEUTRO') neutro, count(*) total_geral from base_posturas_classificadas where filiacao_rede is not null and postura_final is not null group by rollup(filiacao_rede)",
    "crosstab_cells": "select case when grouping(filiacao_rede) = 1 then 'TOTAL_GERAL' else filiacao_rede end filiacao_rede, case when grouping(postura_final) = 1 then 'TOTAL_GERAL' else postura_final end postura_final, count(*) linhas from base_posturas_classificadas where filiacao_rede is not null and postura_final is not null group by cube(filiacao_rede, postura_final)",
    "dense_row_id": "select *, row_number() over (order by turno_id) - 1 linha from (select distinct turno_id, orador_marcador from df_turnos)",
    "positional_zip": "select coalesce(a.linha, b.linha) linha, turno_id, id from (select turno_id, row_number() over (order by turno_id) - 1 linha from (select distinct turno_id from df_turnos)) a full join (select id, row_number() over (order by id) - 1 linha from (select distinct id from publichearingbr_lds)) b on a.linha = b.linha",
    "cast_string": "select linha_id, cast(linha_id as varchar) texto, strftime(classificado_em, '%Y-%m-%d %H:%M:%S') momento from base_posturas_classificadas",
    "banner_repeat": "select distinct postura_final, repeat('=', 80) || chr(10) || postura_final faixa from base_posturas_classificadas where postura_final is not null",
    "empty_frame": "select turno_id, cast(0 as bigint) ordem_chunk, texto_turno chunks from df_turnos where false",
    "propose_offline": f"with {LATEST}, {opinions('hs')}, l as (select id_audiencia, list(opiniao_limpa order by part_ord, op_ord) o from ops group by id_audiencia, assunto_audiencia) select id_audiencia, replace(o[1], '|', '/') || case when o[len(o)] <> o[1] then ' | ' || replace(o[len(o)], '|', '/') else '' end proposicoes_audiencia, false erro from l",
    "stance_detect_offline": f"with {PAIRED} select id_audiencia, part_ord, op_ord, proposicao_alvo, case when regexp_matches(lower(opiniao_limpa), 'favorável|defendo|melhora') then 'A FAVOR' when regexp_matches(lower(opiniao_limpa), 'contra|ninguém|piorou') then 'CONTRA' else 'NEUTRO' end postura_final from paired",
    "graph_nodes": f"with {NODES} select * from nodes",
    "edges_algebraic": f"with {EDGES} select * from edges",
    "edges_classified": f"""with {EDGES}, k as (select *, case when concordancia > discordancia and concordancia >= neutro then 1 when discordancia > concordancia and discordancia >= neutro then 2 else 3 end k from edges)
      select src, dst, concordancia, discordancia, neutro, ['rgba(0, 0, 255, 0.4)', 'rgba(255, 0, 0, 0.4)', 'rgba(169, 169, 169, 0.2)'][k] color, [concordancia, discordancia, greatest(neutro, 1)][k] as "value",
      case k when 1 then 'Aliados (Concordaram: ' || concordancia || ' | Discordaram: ' || discordancia || ' | Neutros: ' || neutro || ')'
        when 2 then 'Antagonistas (Discordaram: ' || discordancia || ' | Concordaram: ' || concordancia || ' | Neutros: ' || neutro || ')'
        else 'Contato Neutro (Neutros: ' || neutro || ' | Concordaram: ' || concordancia || ' | Discordaram: ' || discordancia || ')' end title, concordancia - discordancia peso from k""",
    "edges_pairwise": f"with {EDGES} select * from edges",
    "class_members": f"with {CLASSES} select nome, de classe from said join cl using (k)",
    "edges_between_classes": f"""with {CLASSES}, pr as (select de, n, p, f, c, z from cl join c on nome = de)
      select a.de a, b.de b, any_value(a.n) n_a, any_value(b.n) n_b, cast(sum(a.f * b.f + a.c * b.c) as bigint) concordancia, cast(sum(a.f * b.c + a.c * b.f) as bigint) discordancia,
      cast(sum(a.z * (b.f + b.c + b.z) + (a.f + a.c + a.z) * b.z - a.z * b.z) as bigint) neutro from pr a join pr b on a.p = b.p and (a.de < b.de or a.de = b.de and a.n > 1) group by 1, 2""",
    "graph_dashboard": f"with {EDGES} select (select count(*) from (select src from edges union select dst from edges)) nos, (select count(*) from edges) arestas",
    "graph_connected_nodes": f'with {NODES}, {EDGES.partition("," + chr(10))[2]} select nome, "group" from nodes where nome in (select src from edges union select dst from edges)',
    "graph_size": f"with {EDGES} select (select count(*) from (select src from edges union select dst from edges)) nos, (select count(*) from edges) arestas",
    "topic_first_match": f"with {LATEST}, {people('hs')} select id_audiencia, assunto_audiencia from people where {FILE} order by id_audiencia, part_ord limit 1",
    "topic_turns": f"with {TURNS}, hit as (select id_audiencia, assunto_audiencia from people where {FILE} order by id_audiencia, part_ord limit 1) select id_audiencia, assunto_audiencia, ordem_turno + 1 numero, orador_marcador, texto_turno from turns join hit using (id_audiencia)",
    "topic_fallback": f"with {LATEST}, {people('hs')} select distinct id_audiencia, assunto_audiencia from people where {PATTERN}",
    "csv_roundtrip": "select id_audiencia, nome, proposicao_alvo, postura_final, count(*) n from base_posturas_classificadas group by all",
    "jsonl_roundtrip": "select id, metadados.assunto assunto, length(transcricao) n from publichearingbr_lds",
    "stream_opinions": f"with {opinions('publichearingbr_lds')} select id_audiencia, part_ord, op_ord, opiniao_limpa from ops",
}
