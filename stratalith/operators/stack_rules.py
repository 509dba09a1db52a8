"""Technologies of projects by rules: all terms are looked for in one pass over the texts, by an automaton.

Rules are a table of the user's, (category, technology, place, kind, term, points), of any
length up to MOST_RULES; STARTER is a short one of our own.  Kinds:

  indicator   the term stands in an import, an annotation, a framework pattern, a manifest or any content;
              each of these five channels counts once, with its own points
  dependency  the term stands in a manifest
  config      a file has that name
  extension   files end so; each of the first five counts

Terms are compared without case, names of files with it.  The automaton is made from the
rules on each worker, so a text is read once however many rules there are; a task gives
a row for each project, channel and term that it finds, and all else is joins of those.
Null contents and names hold nothing; repeated files count as files.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOST_RULES = 100_000
RULES = "category string, technology string, place int, kind string, term string, points long"
HITS = "project string, channel string, term string"
# Points of an indicator by channel; words that add points to a category if they stand in any content; files whose text counts as a manifest.
CHANNELS = {"import": 20, "annotation": 15, "pattern": 18, "manifest": 15, "content": 12}
BONUS = {
    "frontend_framework": (5, ("component", "jsx", "tsx", "template", "view", "router")),
    "backend_framework": (5, ("controller", "service", "repository", "api", "endpoint", "middleware")),
    "database": (3, ("select", "insert", "update", "delete", "create table", "alter table")),
}
MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "requirements.txt", "setup.py", "pyproject.toml", "Cargo.toml", "go.mod", "application.properties", "application.yml", "persistence.xml", "web.xml")
SURE, EACH, MOST, FILES, OTHERS = 70, 5, 100, 5, 3

#: Points of a starter rule by its kind.
POINTS = {"indicator": None, "config": 40, "dependency": 35, "extension": 20}
_MARKS = {"=": "config", "+": "dependency", ".": "extension"}
#: Terms of each technology: =config, +dependency, .extension, else an indicator.
STARTER: dict[str, dict[str, str]] = {
    "frontend_framework": {
        "JSF": "javax.faces|h:form|=faces-config.xml|+primefaces|.xhtml",
        "JSP": "<jsp:|<%@|+jstl|.jsp",
        "React": "from 'react'|usestate|+react-dom|.jsx|.tsx",
        "Angular": "@ngmodule|from '@angular|=angular.json|+@angular/core",
        "Vue.js": "from 'vue'|createapp|=vue.config.js|.vue",
        "Thymeleaf": "th:each|+thymeleaf",
        "Svelte": "from 'svelte|=svelte.config.js|.svelte",
    },
    "backend_framework": {
        "Java EE / EJB": "@stateless|javax.ejb|=ejb-jar.xml|+javaee-api",
        "Spring Boot": "@springbootapplication|@restcontroller|=application.properties|+spring-boot",
        "Spring MVC": "@requestmapping|dispatcherservlet|+spring-webmvc",
        "Django": "from django|=manage.py|+django",
        "Flask": "from flask|@app.route|+flask",
        "FastAPI": "from fastapi|@app.post|+fastapi",
        "Express.js": "require('express')|app.listen|+express",
        "ASP.NET Core": "microsoft.aspnetcore|[apicontroller]|.csproj",
        "NestJS": "@nestjs|@controller(|=nest-cli.json",
    },
    "runtime": {
        "Java 8": "<java.version>1.8|<source>1.8",
        "Java 11": "<java.version>11|<release>11",
        "Java 17": "<java.version>17|<release>17",
        "Java 21": "<java.version>21|<release>21",
        "Python 3": "python_requires|async def|=pyproject.toml|.py",
        "Node.js": "process.env|require(|=package.json|.js",
        ".NET 6+": "<targetframework>net|microsoft.net.sdk|.csproj",
        "PHP": "<?php|=composer.json|.php",
    },
    "app_server": {
        "WebSphere": "com.ibm.websphere|=ibm-web-bnd.xml",
        "WebLogic": "weblogic|=weblogic.xml",
        "JBoss / WildFly": "org.jboss|=jboss-web.xml",
        "Tomcat": "org.apache.catalina|+tomcat",
        "Embedded (Spring Boot)": "server.port|+spring-boot-starter-web",
    },
    "database": {
        "DB2": "com.ibm.db2|jdbc:db2",
        "Oracle": "jdbc:oracle|varchar2",
        "PostgreSQL": "jdbc:postgresql|bigserial|+postgresql",
        "MySQL": "jdbc:mysql|auto_increment|image: mysql|+mysql",
        "SQL Server": "jdbc:sqlserver|nvarchar",
        "SQLite": "sqlite3|jdbc:sqlite",
        "MongoDB": "mongodb://|mongoclient|+mongoose",
        "Redis": "redis://|image: redis|+redis",
    },
    "messaging": {
        "IBM MQ": "com.ibm.mq|mqqueuemanager",
        "Kafka": "kafkatemplate|bootstrap-servers|+kafka",
        "RabbitMQ": "rabbittemplate|image: rabbitmq|+amqp",
        "ActiveMQ": "activemqconnectionfactory|+activemq",
        "Apache Pulsar": "pulsarclient|+pulsar-client",
    },
    "build_tool": {
        "Maven": "<artifactid>|=pom.xml",
        "Gradle": "implementation '|=build.gradle",
        "npm": "npm run|=package-lock.json|=package.json",
        "Yarn": "yarn add|=yarn.lock",
        "pnpm": "pnpm install|=pnpm-lock.yaml",
        "pip": "pip install|=requirements.txt",
        "Composer": "composer install|=composer.json",
        "dotnet CLI": "dotnet build|packagereference|.csproj",
    },
    "orm": {
        "OpenJPA": "org.apache.openjpa|+openjpa",
        "Hibernate": "org.hibernate|+hibernate-core",
        "Spring Data JPA": "jparepository|+spring-boot-starter-data-jpa",
        "EclipseLink": "org.eclipse.persistence|+eclipselink",
        "SQLAlchemy": "declarative_base|from sqlalchemy|+sqlalchemy",
        "Django ORM": "models.model|django.db",
        "Entity Framework": "entityframeworkcore|dbcontext",
        "Sequelize": "sequelize.define|+sequelize",
        "Prisma": "prismaclient|=schema.prisma",
    },
}


def starter_rules() -> list[tuple]:
    """Rows (RULES) of STARTER; a technology's place is its order in its category."""
    out = []
    for category, technologies in STARTER.items():
        for place, (technology, terms) in enumerate(technologies.items()):
            for term in terms.split("|"):
                kind = _MARKS.get(term[0], "indicator")
                out.append((category, technology, place, kind, term[1:] if kind in ("config", "dependency") else term, POINTS[kind]))
    return out


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def hits(texts: DataFrame, terms: list[str]) -> DataFrame:
    """HITS of texts (project, channel, text): which terms stand in them, each once."""
    low = sorted({t.lower() for t in terms if t})

    def search(batches):
        automaton = ahocorasick.Automaton()
        for t in low:
            automaton.add_word(t, t)
        if low:
            automaton.make_automaton()
        for batch in batches:
            seen: set[tuple] = set()
            for project, channel, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and low:
                    seen |= {(project, channel, term) for term in {t for _, t in automaton.iter(text.lower())}}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(seen, key=str), strict=True)], names=["project", "channel", "term"])

    three = texts.select(F.col("project").cast("string").alias("project"), "channel", "text").filter("text is not null")
    return three.mapInArrow(search, HITS).distinct()


def stack_scores(files: DataFrame, rules: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(project, category, technology, place, score) of what rules find in files (project, path, content); marks: (project, channel, text) of imports, annotations and patterns.

    Points are summed; what is below 70 is lifted to 70 and 5 for each indicator found in contents or manifests; 100 at most."""
    rows = rules.select("category", "technology", "place", "kind", "term", "points").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    spark = files.sparkSession
    ruled = spark.createDataFrame([(*r[:4], r["term"].lower() if r["kind"] in ("indicator", "dependency") else r["term"], r["points"]) for r in rows], RULES)
    words = [(c, w, points) for c, (points, each) in BONUS.items() for w in each]
    manifest = F.when(file_name("path").isin(*MANIFESTS), F.array(F.lit("content"), F.lit("manifest"))).otherwise(F.array(F.lit("content")))
    files = files.select(F.col("project").cast("string").alias("project"), "path", "content")
    texts = files.select("project", F.explode(manifest).alias("channel"), F.col("content").alias("text"))
    if marks is not None:
        texts = texts.unionByName(marks.select(F.col("project").cast("string").alias("project"), "channel", "text"))
    found = hits(texts, [r["term"] for r in rows if r["kind"] in ("indicator", "dependency")] + [w for _, w, _ in words])

    key = ["project", "category", "technology", "place"]
    by_channel = F.lit(0).cast("long")
    for channel, points in CHANNELS.items():
        by_channel = F.when(F.col("channel") == channel, F.lit(points).cast("long")).otherwise(by_channel)
    indicators = found.join(ruled.filter("kind = 'indicator'").drop("points"), "term").select(*key, by_channel.alias("points"), F.when(F.col("channel").isin("content", "manifest"), F.col("term")).alias("sure"))
    plain = lambda df: df.select(*key, F.col("points"), F.lit(None).cast("string").alias("sure"))
    dependencies = plain(found.filter("channel = 'manifest'").join(ruled.filter("kind = 'dependency'"), "term"))
    config = plain(files.select("project", file_name("path").alias("term")).distinct().join(ruled.filter("kind = 'config'"), "term"))
    endings = files.select("project", F.lower(F.regexp_extract(file_name("path"), r"(\.[^.]*)$", 1)).alias("term")).groupBy("project", "term").agg(F.count("*").alias("n"))
    extensions = plain(endings.join(ruled.filter("kind = 'extension'"), "term").withColumn("points", F.col("points") * F.least("n", F.lit(FILES))))
    all_ = indicators.unionByName(dependencies).unionByName(config).unionByName(extensions)
    sums = all_.groupBy(*key).agg(F.sum("points").alias("points"), F.countDistinct("sure").alias("sure"))
    extra = found.filter("channel = 'content'").join(spark.createDataFrame(words, "category string, term string, bonus long"), "term").groupBy("project", "category").agg(F.sum("bonus").alias("bonus"))
    score = F.col("points") + F.coalesce("bonus", F.lit(0))
    score = F.when((score < SURE) & (F.col("sure") > 0), F.greatest(score, SURE + EACH * F.col("sure"))).otherwise(score)
    return sums.join(extra, ["project", "category"], "left").select(*key, F.least(score, F.lit(MOST)).cast("long").alias("score"))


def detected(scores: DataFrame) -> DataFrame:
    """(project, category, detected, confidence, alternatives): the best technology of each category that has 70 points, and up to three others that have; ties by place."""
    order = W.partitionBy("project", "category").orderBy(F.desc("score"), "place")
    top = scores.filter(F.col("score") >= SURE).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= OTHERS + 1)
    names = F.transform(F.array_sort(F.collect_list(F.struct("n", "technology"))), lambda x: x["technology"])
    each = top.groupBy("project", "category").agg(names.alias("names"), F.max("score").alias("confidence"))
    return each.select("project", "category", F.get("names", F.lit(0)).alias("detected"), "confidence", F.slice("names", 2, OTHERS).alias("alternatives"))


def rules_of(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """A rule table; the starter rules if no rows are given."""
    return spark.createDataFrame(rows if rows is not None else starter_rules(), RULES)
