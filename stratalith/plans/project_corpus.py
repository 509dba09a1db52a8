"""Projects of source files, (project, file_no, path, content), made of the rows of part: each row is one file of its project.

Files are written out below; a ~ stands for the project's number.  So expected rows are stated by hand, apart from
the operators that must find them.  Which files a project has differs from one to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt, table

_LONG = "\n".join(f"        total += step({i});" for i in range(55))
FILES: list[tuple[str, str]] = [
    (
        "src/main/java/com/shop/OrderController.java",
        """package com.shop;

import com.shop.OrderService;
import org.springframework.web.bind.annotation.*;

// class Ghost { }
@RestController
@RequestMapping("/api/orders~")
public class OrderController extends BaseController {
    private String brace = "} class Fake {";

    @GetMapping("/{id}")
    public Order find(@PathVariable Long id) {
        if (id == null) { return null; }
        return service.find(id);
    }

    @PostMapping
    public Order create(@RequestBody Order order) {
        return service.create(order);
    }

    @RequestMapping("/all")
    public List<Order> all() { return service.all(); }
}
""",
    ),
    (
        "src/main/java/com/shop/OrderService.java",
        """package com.shop;

import com.shop.OrderRepository;

@Stateless
public class OrderService {
    /* public void hidden() { } */
    public Order find(Long id) {
        return em.createQuery("select o from Order~ o where o.id = :id").getSingleResult();
    }

    protected int total(int n) {
        int total = 0;
"""
        + _LONG
        + """
        return total;
    }
}
""",
    ),
    (
        "src/main/java/com/shop/OrderRepository.java",
        """package com.shop;

import com.shop.Order;

public interface OrderRepository extends JpaRepository<Order, Long> {
}

@Entity
@Table(name = "orders_~")
class Order {
    private Long id;
    private List<String> notes = new ArrayList<>();
}
""",
    ),
    ("pom.xml", "<project>\n  <artifactId>shop~</artifactId>\n  <dependency>spring-boot-starter-web</dependency>\n  <dependency>hibernate-core</dependency>\n  <dependency>postgresql</dependency>\n</project>\n"),
    ("src/main/resources/application.properties", "spring.datasource.url=jdbc:postgresql://db/shop~\nspring.kafka.bootstrap-servers=kafka:9092\n"),
    (
        "api/app/routers/users.py",
        '''"""class Nothing: users of project ~"""
import os
from api.app.services.user_service import UserService


@app.post("/users~")
async def create_user(name: str, mail: str = "def no():"):
    # def commented(): pass
    return UserService().create(name)


@app.get("/users~/{user_id}")
def get_user(user_id: int):
    cursor.execute("select * from users_~ where id = 1")
    return None
''',
    ),
    (
        "api/app/services/user_service.py",
        '''from api.app.models import Base
import api.app.routers.users


class UserService(Base):
    """Serves.

    class Docs: no
    """

    def create(self, name):
        global counter
        for c in name:
            counter += 1
        return counter
''',
    ),
    ("api/app/models.py", "from sqlalchemy.orm import declarative_base\n\nBase = declarative_base()\n\n\nclass User~(Base):\n    __tablename__ = 'users_~'\n    name = None\n"),
    ("api/requirements.txt", "fastapi==0.1~\nuvicorn\nsqlalchemy\nredis\n"),
    ("legacy/app.py", "from flask import Flask\n\napp = Flask(__name__)\n\n\n@app.route('/items~', methods=['GET', 'POST'])\n@login_required\ndef items():\n    return 'ok'\n\n\n@app.route('/ping')\ndef ping():\n    return 'pong'\n"),
    ("legacy/shop/urls.py", "from django.urls import path\nimport legacy.shop.views\n\nurlpatterns = [\n    path('items~/', views.items),\n    # path('no/', views.no),\n    path('about/', about_view),\n]\n"),
    ("legacy/shop/views.py", "from django.shortcuts import render\nimport legacy.shop.urls\n\n\ndef items(request):\n    return render(request, 'items~.html')\n"),
    ("web/package.json", '{"name": "web~", "dependencies": {"react": "18", "express": "4", "next": "14"}}\n'),
    (
        "web/server.js",
        """const express = require('express');
const app = express();

app.get('/shop~/:id', async (req, res) => {
  const o = { a: 1, b: '}' };
  res.json(o);
});
app.post('/shop~', save);
// app.put('/nothing', save);

async function save(req, res) {
  return `function no() { ${req} }`;
}
""",
    ),
    (
        "web/src/components/Card.tsx",
        """import React, { useState } from 'react';
import { money } from '../format';

export const Card~ = (props: Props): JSX.Element => {
  const [open, setOpen] = useState(false);
  return <div className="card">{money(props.price)}</div>;
}

export class CardStore {
  items = [];
}
""",
    ),
    ("web/src/format.ts", "export function money(x: number): string {\n  return '$' + x; // export class No {}\n}\n"),
    (
        "server/ItemsController.cs",
        """using System;
using Microsoft.AspNetCore.Mvc;

[ApiController]
[Route("api/items~")]
public class ItemsController : ControllerBase
{
    [HttpGet("{id}")]
    public Item Get(int id) { return null; }

    [HttpDelete]
    public async Task Remove(int id)
    {
        await Task.Delay(1);
    }
}

[Table("items_~")]
public class Item { public int Id { get; set; } }
""",
    ),
    ("server/shop.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"><PackageReference Include="Microsoft.EntityFrameworkCore" /></Project>\n'),
    (
        "worker/main.go",
        """package main

import (
	"fmt"
	"net/http"
)

type Job~ struct {
	ID int
}

type Runner interface {
	Run(x int) error
}

func (j *Job~) Run(x int) error {
	fmt.Println("func no() {")
	return nil
}

func main() {
	http.ListenAndServe(":80", nil)
}
""",
    ),
    (
        "db/schema.sql",
        """-- create table ghost (id int);
CREATE TABLE customers_~ (
  id BIGINT PRIMARY KEY,
  name VARCHAR(100) DEFAULT 'a; CREATE TABLE no',
  region_id INT,
  FOREIGN KEY (region_id) REFERENCES regions_~ (id)
);
CREATE TABLE IF NOT EXISTS shop.regions_~ (id INT, label TEXT);
CREATE UNIQUE INDEX idx_name_~ ON customers_~ (name);
CREATE OR REPLACE VIEW rich_~ AS SELECT * FROM customers_~;
ALTER TABLE customers_~ ADD COLUMN note TEXT;
""",
    ),
    (
        "mainframe/PAY.cbl",
        """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAY~.
      * CALL 'NOTHING'.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
           COPY PAYREC.
       MAIN-PARA.
           CALL 'TAX~' USING AMOUNT.
           EXEC SQL
             SELECT X FROM PAYROLL_~
           END-EXEC.
""",
    ),
    ("deploy/docker-compose.yml", "services:\n  broker:\n    image: rabbitmq:3\n  cache:\n    image: redis\n  db:\n    image: mysql~\n"),
    ("web/pages/index.xhtml", '<html xmlns:h="http://xmlns.jcp.org/jsf/html">\n<h:form><h:inputText value="#{bean}"/></h:form>\n</html>\n'),
    ("README.md", "# Shop ~\n\nOrders, customers and invoices.\n"),
]


def _kept(project: str, kind: str) -> str:
    """Which files a project has."""
    return f"({project} * 5 + {kind}) % 7 <> 0"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: For the engine that results are compared with.
PROJECT_SQL = (
    "templates AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {_literal(path)}, {_literal(content)})" for k, (path, content) in enumerate(FILES))
    + f""") t(kind, path, content)),
project_files AS (SELECT project, file_no, kind, 'p' || project || '/' || path AS path, replace(content, '~', CAST(project AS VARCHAR)) AS content
  FROM (SELECT (p_partkey - 1) // {len(FILES)} AS project, p_partkey AS file_no, (p_partkey - 1) % {len(FILES)} AS kind FROM part) p JOIN templates USING (kind) WHERE {_kept("project", "kind")})"""
)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, file_no, path, content); a project's files are in one task, and a task has some thousands of them."""
    templates = spark.createDataFrame([(k, *f) for k, f in enumerate(FILES)], "kind long, template string, text string")
    n = F.col("p_partkey") - 1
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.floor(n / len(FILES)).alias("project"), F.col("p_partkey").alias("file_no"), (n % len(FILES)).alias("kind")).filter(_kept("project", "kind"))
    rows = dealt(rows, parts.count(), "project")
    number = F.col("project").cast("string")
    # as many templates as are written above
    return rows.join(F.broadcast(templates), "kind").select("project", "file_no", F.concat(F.lit("p"), number, F.lit("/"), "template").alias("path"), F.replace("text", F.lit("~"), number).alias("content"))
