"""Adapter views: the library's tables, made from the test tables. One text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "materia": """select materia_id, concat('MATERIA_',
  cast(materia_id as string)) as nome,
  cast(case when materia_id = 7 then 0 else 0.5 + 0.25*materia_id end as decimal(5,2)) as peso_prova, true as ativa
from (select cast(n_nationkey as bigint) as materia_id
from nation where n_nationkey < 8) t""",
    "assunto": """select p_partkey as assunto_id, p_partkey % 8 as materia_id, concat(p_name, ' ',
  cast(p_partkey as string)) as nome, (p_size % 4) + 1 as semana_do_ciclo, true as ativo
from part""",
    "sessao": """select l_orderkey as pai_id, o_custkey as aluno_id, l_shipdate as data, l_suppkey % 8 as materia_id, (l_partkey % 15) * 8 + (l_suppkey % 8) as assunto_id,
  case l_returnflag when 'A' then 'TEORIA' when 'N' then 'QUESTOES' else 'REVISAO' end as tipo_sessao,
  cast(l_quantity as int) as minutos_liquidos,
  case when l_linenumber > 5 then null else l_linenumber end as nivel_foco,
  case when l_partkey % 6 = 0 then null else cast(l_partkey % 6 as int) end as nivel_energia
from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'F'""",
    "bloco": """select o_orderkey as bloco_id, o_custkey as aluno_id, o_orderdate as data, o_orderkey % 8 as materia_id, (o_custkey % 15) * 8 + (o_orderkey % 8) as assunto_id,
  cast(substring(o_orderpriority, 1, 1) as int) as dificuldade,
  cast(10 + o_orderkey % 41 as int) as total_questoes,
  cast((10 + o_orderkey % 41) - (o_orderkey * 7 + o_custkey) % (4 + o_orderkey % 7) as int) as total_acertos,
  cast(600 + o_orderkey % 9001 as int) as tempo_total_segundos,
  case when o_custkey % 6 = 0 then null else cast(o_custkey % 6 as int) end as nivel_confianca_medio
from orders where o_orderstatus in ('F','O')""",
    "erro": """select l_orderkey as bloco_id,
  case l_linenumber when 1 then 'CONCEITO' when 2 then 'INTERPRETACAO' when 3 then 'CALCULO' when 4 then 'DISTRACAO' when 5 then 'PRESSA' else 'CONTEUDO_ESQUECIDO' end as tipo_erro,
  cast(1 + l_partkey % 3 as int) as quantidade
from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus in ('F','O') and l_linestatus = 'O'""",
    "simulado": """select o_orderkey as simulado_id, o_custkey as aluno_id,
  cast(1 + o_custkey % 12 as int) as numero_ciclo,
  cast(1 + o_orderkey % 4 as int) as numero_semana, 90 as total_questoes,
  cast(45 + (o_orderkey * 7 + o_custkey) % 46 as int) as total_acertos,
  cast(7200 + o_orderkey % 9001 as int) as tempo_total_segundos,
  case when o_orderkey % 6 = 0 then null else cast(o_orderkey % 6 as int) end as nivel_ansiedade,
  case when o_custkey % 6 = 0 then null else cast(o_custkey % 6 as int) end as nivel_fadiga,
  cast(1 + o_custkey % 5 as int) as qualidade_sono, o_orderdate as criado_em
from orders where o_orderstatus = 'P'""",
    "desempenho_simulado": """select l_orderkey as simulado_id, l_suppkey % 8 as materia_id,
  cast(l_quantity as int) as total_questoes,
  cast(l_quantity as int) - cast(l_partkey % (cast(l_quantity as int) + 1) as int) as total_acertos,
  cast(60 + l_partkey % 1800 as int) as tempo_total_segundos
from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'""",
    "redacao": """select doc_id as redacao_id, doc_id % 150 as aluno_id, source as tema, lang as eixo_tematico,
  cast(date '1995-01-01' + cast(doc_id % 2400 as int) as timestamp) as data_escrita,
  case when n_chars % 5 = 0 then null else cast(30 + n_chars % 60 as int) end as tempo_escrita_min,
  cast(((doc_id * 3 + n_chars) % 11) * 20 as int) as competencia1,
  cast(((doc_id * 5 + n_chars) % 11) * 20 as int) as competencia2,
  cast(((doc_id * 7 + n_chars) % 11) * 20 as int) as competencia3,
  cast(((doc_id * 11 + n_chars) % 11) * 20 as int) as competencia4,
  cast(((doc_id * 13 + n_chars) % 11) * 20 as int) as competencia5
from documents""",
    "prova": """select s_suppkey as prova_id, s_nationkey as aluno_id,
  cast(1990 + s_suppkey % 30 as int) as ano,
  cast((s_suppkey * 37) % 101 as decimal(5,2)) as nota_total,
  cast(9000 + (s_suppkey * 61) % 7200 as int) as tempo_total_segundos,
  case when s_suppkey % 6 = 0 then null else cast(s_suppkey % 6 as int) end as nivel_ansiedade,
  cast(1 + s_suppkey % 5 as int) as nivel_fadiga,
  cast(1 + s_nationkey % 5 as int) as qualidade_sono,
  cast(date '1995-01-01' + cast((s_suppkey * 23) % 2400 as int) as timestamp) as criado_em
from supplier""",
    "atividade": """select user_id as aluno_id, ts as data, event_id % 8 as materia_id,
  cast(1 + event_id % 55 as int) as minutos_liquidos,
  case event_type when 'view' then 'TEORIA' when 'click' then 'QUESTOES' when 'purchase' then 'QUESTOES' else 'REVISAO' end as tipo_sessao
from events""",
    "desempenho_prova": """select p.prova_id, m.materia_id, cast((p.prova_id * 17 + m.materia_id * 29) % 101 as decimal(5,2)) as percentual_acerto,
  cast(600 + (p.prova_id * 13 + m.materia_id) % 1200 as int) as tempo_total_segundos
from prova p cross join materia m""",
}
#: What each view is made of: test tables, or other views.
NEEDS = {
    "materia": ["nation"],
    "assunto": ["part"],
    "sessao": ["lineitem", "orders"],
    "bloco": ["orders"],
    "erro": ["lineitem", "orders"],
    "simulado": ["orders"],
    "desempenho_simulado": ["lineitem", "orders"],
    "redacao": ["documents"],
    "prova": ["supplier"],
    "atividade": ["events"],
    "desempenho_prova": ["prova", "materia"],
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder."""
    needs = {n: view(spark, folder, n) if n in VIEWS else spark.read.parquet(f"{folder}/{n}.parquet") for n in NEEDS[name]}
    return spark.sql(re.sub(r"\b(from|join) (" + "|".join(needs) + r")\b", r"\1 {\2}", VIEWS[name]), **needs)


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: view(spark, folder, n) for n in names}


def ctes(*names: str) -> list[str]:
    """The views as common table expressions, those that others need first."""
    return [f"{n} as ({VIEWS[n]})" for n in VIEWS if n in names or n in ("prova", "materia") and "desempenho_prova" in names]
