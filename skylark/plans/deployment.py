"""Compose files, profile documents and gateway routes of the synthetic snapshot, as YAML."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylark.plans.catalog import query
from skylark.plans.synthetic import VIEWS
from skylark.sources import deployment

VIEWS.update({
    "syn_compose": """
        SELECT service_id AS repo, concat(CAST(service_id AS STRING), '/', name) AS path, name, CASE WHEN name = 'compose.override.yml' THEN concat('services: {{', own, ': {{hostname: over-', own, ', ports: ["', CAST(port AS STRING), ':81"]}}}}', chr(10))
          WHEN name = 'compose.yaml' THEN 'services: {{never: {{}}}}'
          ELSE concat('services:', chr(10), '  ', own, ':', chr(10), '    hostname: ', own, '-host', chr(10), '    ports: [', CAST(port AS STRING), ', "1:', CAST(port + 1 AS STRING), '/tcp"]', chr(10), '    build: ./', app, '/', chr(10),
            '    networks: {{n: {{aliases: [', app, ', ', own, ']}}}}', chr(10), CASE WHEN service_id % 2 = 0 THEN concat('    environment: {{A_URL: ', app, ', B: null, C: null}}') ELSE concat('    environment: ["A_URL=', app, '", B, C]') END, chr(10)) END AS content
        FROM (SELECT service_id, port, own, app, f.name FROM (SELECT service_id, port, name AS own, app_name AS app FROM {syn_service}) s
          JOIN (SELECT 'compose.yml' AS name UNION ALL SELECT 'compose.yaml' UNION ALL SELECT 'compose.override.yml') f ON f.name <> 'compose.override.yml' OR service_id % 3 = 0) x""",
    "syn_profile_file": """
        SELECT service_id, concat(CAST(service_id AS STRING), '/application.yml') AS path, 0 AS file_ord, FALSE AS is_profile, concat('server: {{port: ', CAST(port AS STRING), '}}', chr(10), 'names: [', app_name, ', ', name, ']', chr(10), '---', chr(10),
          'spring: {{config: {{activate: {{on-profile: "dev, p', CAST(service_id % 4 AS STRING), '"}}}}}}', chr(10), 'server.port: ', CAST(port + 1000 AS STRING), chr(10), 'extra: ', name, chr(10), '---', chr(10), 'spring.profiles: q', CAST(service_id % 3 AS STRING), chr(10), 'server: {{port: ', CAST(port + 2000 AS STRING), '}}', chr(10),
          '---', chr(10), 'spring: {{cloud: {{gateway: {{routes: [{{id: r, uri: "lb://', app_name, '", predicates: ["Path=/', name, '/**,/x"], filters: [StripPrefix=', CAST(service_id % 3 AS STRING), ']}}, {{uri: "lb://y", predicates: [{{name: Path, args: {{p: /y}}}}]}}]}}}}}}', chr(10)) AS content
        FROM {syn_service}""",
})

if deployment.available:

    @query("s06_compose_identities", """
    SELECT service_id AS repo, name AS service, concat(name, ',', CASE WHEN service_id % 3 = 0 THEN concat('over-', name) ELSE concat(name, '-host') END, ',', app_name) AS hostnames, CASE WHEN service_id % 3 = 0 THEN '81' ELSE concat(port, ',', port + 1) END AS ports, app_name AS context FROM syn_service""")
    def _(v):
        files = v.syn_compose
        joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
        return deployment.identities(deployment.compose_services(files, deployment.documents(files))).select("repo", "service", joined("hostnames"), joined("ports"), "context")

    @query("s09_environments", """
    SELECT service_id AS repo, name AS service, e.k AS name, CASE e.k WHEN 'A_URL' THEN app_name WHEN 'B' THEN CASE WHEN service_id % 5 = 0 THEN 'b' ELSE '' END WHEN 'C' THEN '' ELSE 'z' END AS value
    FROM syn_service, (VALUES ('A_URL'), ('B'), ('C')) e(k) WHERE e.k = 'A_URL' OR service_id % 2 = 0 OR (e.k = 'B' AND service_id % 5 = 0)""")
    def _(v):
        files = v.syn_compose
        dotenv = v.syn_service.where("service_id % 5 = 0").select(F.col("service_id").alias("repo"), F.lit("B").alias("key"), F.lit("b").alias("value"))
        none = dotenv.limit(0).select("repo", F.col("key").alias("file"), "key", "value")
        return deployment.environments(deployment.compose_services(files, deployment.documents(files)), dotenv, none)

    @query("s13_profile_settings", """
    WITH s AS (SELECT *, CASE service_id % 5 WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2 THEN ['p2', 'q0'] ELSE ['dev'] END AS a, service_id % 5 = 0 AS every FROM syn_service),
    t AS (SELECT *, every OR coalesce(list_contains(a, 'dev') OR list_contains(a, concat('p', service_id % 4)), FALSE) AS two, every OR coalesce(list_contains(a, concat('q', service_id % 3)), FALSE) AS three FROM s)
    SELECT service_id, 'server.port' AS key, CAST(CASE WHEN three THEN port + 2000 WHEN two THEN port + 1000 ELSE port END AS VARCHAR) AS value FROM t UNION ALL SELECT service_id, 'names', concat(app_name, ',', name) FROM t UNION ALL SELECT service_id, 'extra', name FROM t WHERE two
    UNION ALL SELECT service_id, 'spring.cloud.gateway.routes', '(routes)' FROM t""")
    def _(v):
        files, five = v.syn_profile_file, F.col("service_id") % 5
        active = v.syn_service.select("service_id", F.when(five == 1, F.array().cast("array<string>")).when(five == 2, F.array(F.lit("p2"), F.lit("q0"))).when(five > 2, F.array(F.lit("dev"))).alias("profiles"))
        settings = deployment.profile_entries(files.drop("content"), deployment.documents(files), active)[0]
        return settings.withColumn("value", F.when(F.col("key") == deployment.ROUTES, "(routes)").otherwise(F.col("value")))

    @query("f42_gateway_routes", """
    SELECT concat(service_id, '/application.yml') AS path, 3 AS doc, r.ord, CASE WHEN r.ord = 0 THEN 'r' END AS route_id, CASE r.p WHEN 'n' THEN concat('/', name, '/**') ELSE r.p END AS path_prefix, CASE r.ord WHEN 0 THEN concat('lb://', app_name) ELSE 'lb://y' END AS target_uri, CASE r.ord WHEN 0 THEN service_id % 3 ELSE 0 END AS strip
    FROM syn_service, (VALUES (0, 'n'), (0, '/x'), (1, '/y')) r(ord, p)""")
    def _(v):
        return deployment.gateway_routes(deployment.documents(v.syn_profile_file))
