"""Catalogue tables seen through the TPC-H style input tables.

Every view is one SELECT that reads the same in Spark SQL and in DuckDB, so a
query and its checking SQL start from the same rows. ``{name}`` stands for an
input table or another view.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["f_chapters"] = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id,
       l_partkey AS work_id,
       CAST(l_partkey * 100000 + l_suppkey AS BIGINT) AS source_id,
       l_suppkey AS site_id,
       CASE WHEN l_partkey % 4 = 0 THEN 'manhwa' WHEN l_suppkey % 2 = 0 THEN 'novela' ELSE 'manhwa' END AS tipo,
       CASE l_suppkey % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' ELSE 'pt' END AS idioma,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN l_partkey % 8 = 4 THEN CAST(l_quantity AS INT) % 5
            WHEN l_partkey % 4 <> 0 AND l_suppkey % 2 = 0 THEN CAST(l_quantity AS INT) * 3
            ELSE CAST(l_quantity AS INT) END AS numero,
       CASE l_linenumber % 4 WHEN 0 THEN concat('Capítulo ', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)))
            WHEN 1 THEN concat('Chapter ', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)), ': The End')
            WHEN 2 THEN concat('Cap. 0', CAST(CAST(l_quantity AS INT) AS VARCHAR(10)))
            ELSE 'Prólogo' END AS titulo,
       concat('https://www.site', CAST(l_suppkey % 10 AS VARCHAR(10)), '.example.com/w/', CAST(l_partkey AS VARCHAR(10)),
              '/capitulo-', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(20))) AS url,
       NOT (l_returnflag = 'R' AND l_linestatus = 'F') AS aprobado,
       l_shipdate AS visto_en
FROM {lineitem}
"""

VIEWS["f_sources"] = """
SELECT source_id, work_id, site_id, max(tipo) AS tipo, max(idioma) AS idioma,
       concat('Site ', CAST(site_id % 20 AS VARCHAR(10))) AS nombre,
       CAST(count(*) AS INT) AS n_caps, max(visto_en) AS ultimo_cambio, min(visto_en) AS ultimo_scrape,
       CASE WHEN site_id % 10 = 0 THEN 'enlace' ELSE 'madara' END AS plataforma,
       site_id % 9 <> 0 AS activa,
       CASE WHEN site_id % 7 = 0 THEN 'Chapter' WHEN site_id % 11 = 0 THEN 'Cap' ELSE NULL END AS titulo_prefijo,
       CASE WHEN site_id % 4 = 0 THEN NULL
            WHEN site_id % 4 = 1 THEN concat('https://uploads.mangadex.org/covers/', CAST(work_id AS VARCHAR(10)), '.jpg')
            WHEN site_id % 4 = 2 THEN concat('https://img.site', CAST(site_id % 10 AS VARCHAR(10)), '.example.com/',
                                             CAST(work_id AS VARCHAR(10)), '.webp')
            ELSE 'data:image/svg+xml,vacio' END AS portada_vista
FROM {f_chapters} GROUP BY source_id, work_id, site_id
"""

VIEWS["f_works"] = """
SELECT p_partkey AS work_id, concat('w-', CAST(p_partkey AS VARCHAR(10))) AS slug,
       concat(p_name, ' ', CAST(p_partkey % 97 AS VARCHAR(10))) AS titulo,
       CASE p_partkey % 3 WHEN 0 THEN concat('The ', p_name, ' of the ', lower(p_type), ' ', CAST(p_size AS VARCHAR(10)))
            WHEN 1 THEN concat('El ', p_name, ' del señor ', lower(p_type)) ELSE NULL END AS alt1,
       CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' ', CAST(p_partkey % 89 AS VARCHAR(10)), ' Novela') ELSE NULL END AS alt2,
       CASE WHEN p_partkey % 7 = 0 THEN concat('화산귀환 ', CAST(p_partkey AS VARCHAR(10))) ELSE NULL END AS alt3,
       CASE p_partkey % 8 WHEN 0 THEN 'Action' WHEN 1 THEN 'martial_arts' WHEN 2 THEN 'Romance' WHEN 3 THEN 'Fantasía'
            WHEN 4 THEN 'Isekai' WHEN 5 THEN 'Sci-fi' WHEN 6 THEN 'Drama' ELSE 'Slice of Life' END AS tag1,
       CASE WHEN p_size = 1 THEN 'Smut' WHEN p_size = 2 THEN 'Hentai' WHEN p_size = 3 THEN 'adult'
            WHEN p_size = 50 THEN 'Lolicon' WHEN p_size % 10 = 4 THEN 'Acción' WHEN p_size % 10 = 5 THEN 'Murim'
            WHEN p_size % 10 = 6 THEN 'Regressor' WHEN p_size % 10 = 7 THEN 'Cultivo raro'
            WHEN p_size % 10 = 8 THEN '  Comedy ' ELSE NULL END AS tag2,
       CASE WHEN p_partkey % 9 = 0 THEN 'ACTION' WHEN p_partkey % 9 = 1 THEN '' ELSE p_brand END AS tag3,
       p_type AS genre1, p_brand AS genre2, p_size >= 45 AS destacada, p_size > 1 AS publicada,
       p_size <= 3 AS adulta, p_partkey % 11 = 0 AS con_trafico, p_retailprice AS creada_ord,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE DATE '2026-01-01' + CAST(p_partkey % 300 AS INT) END AS creada_en,
       CASE p_partkey % 4 WHEN 0 THEN 'Finalizado' WHEN 1 THEN 'En emisión' ELSE '' END AS estado,
       CASE WHEN p_partkey % 50 = 0 THEN 'ambos' WHEN p_partkey % 2 = 0 THEN 'manhwa' ELSE 'novela' END AS tipo,
       CASE p_partkey % 6 WHEN 0 THEN ''
            WHEN 1 THEN concat('https://uploads.mangadex.org/covers/', CAST(p_partkey AS VARCHAR(10)), '.jpg')
            WHEN 2 THEN concat('https://img1.imageshack.us/', CAST(p_partkey AS VARCHAR(10)), '.png')
            WHEN 3 THEN '/portadas/sin-portada.svg'
            ELSE concat('https://cdn.site', CAST(p_partkey % 10 AS VARCHAR(10)), '.example.com/c/',
                        CAST(p_partkey AS VARCHAR(10)), '.jpg') END AS portada_url
FROM {part}
"""

VIEWS["f_synopses"] = "SELECT doc_id AS work_id, text AS sinopsis, lang FROM {documents}"

VIEWS["f_votes"] = """
SELECT event_id AS id, user_id, CAST(event_id % 40 AS BIGINT) AS work_id,
       CAST(floor(abs(value)) AS INT) % 20 + 1 AS capitulo_manhwa,
       CAST(event_id % 5 AS INT) + 1 AS capitulo_novela, ts AS creada_en
FROM {events}
"""

VIEWS["f_anchors"] = """
SELECT o_custkey AS work_id, CAST(o_orderkey % 50 AS INT) + 1 AS capitulo_manhwa,
       max((CAST(o_orderkey % 50 AS INT) + 1) * 2 + CAST(o_orderkey % 3 AS INT)) AS capitulo_novela
FROM {orders} GROUP BY o_custkey, CAST(o_orderkey % 50 AS INT) + 1
"""

VIEWS["f_progress"] = """
SELECT user_id, CAST(event_id % 15 AS BIGINT) AS work_id, CAST(floor(abs(value)) AS INT) % 50 + 1 AS capitulo,
       event_id % 2 = 0 AS es_local, event_type = 'purchase' AS favorito, ts
FROM {events}
"""


class Tables:
    """Input tables and fixture views of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A SELECT over input tables and views named in braces."""
        used = {n: self.base(n) for n in BASE_TABLES if "{" + n + "}" in text}
        used |= {n: self.sql(VIEWS[n]) for n in VIEWS if "{" + n + "}" in text}
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    @cached_property
    def all_chapters(self) -> DataFrame:
        return self.view("f_chapters")

    @cached_property
    def chapters(self) -> DataFrame:
        """Approved chapters only: what the catalogue shows."""
        return self.all_chapters.where("aprobado")

    @cached_property
    def sources(self) -> DataFrame:
        return self.view("f_sources")

    @cached_property
    def works(self) -> DataFrame:
        present = lambda *names: F.filter(F.array(*names), lambda x: x.isNotNull())
        return (
            self.view("f_works")
            .withColumn("titulos_alternativos", present("alt1", "alt2", "alt3"))
            .withColumn("categorias", present("tag1", "tag2", "tag3"))
        )

    @cached_property
    def synopses(self) -> DataFrame:
        return self.view("f_synopses")

    @cached_property
    def votes(self) -> DataFrame:
        return self.view("f_votes")

    @cached_property
    def anchors(self) -> DataFrame:
        return self.view("f_anchors")

    @cached_property
    def progress(self) -> DataFrame:
        return self.view("f_progress")
