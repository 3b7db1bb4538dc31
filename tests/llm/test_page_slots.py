"""Main text that lies beside a page's largest container, or under names that only look like menus."""

from __future__ import annotations

from tenderlens.llm import templates


def texts(spark, made: list[str]) -> list[str]:
    pages = spark.createDataFrame([(i, f"http://slots.example/{i}", h) for i, h in enumerate(made)], "page_id bigint, url string, html string")
    return [r.text for r in templates.extract_pages(pages).orderBy("page_id").collect()]


def test_title_and_lead_outside_the_body_container(spark):
    body = [f"Body {i} " + "long " * 200 + "end" for i in range(4)]
    shell = "<body><nav>Menu</nav><h1>Title {0}</h1><p>Lead {0}</p><div class=content><p>{1}</p></div><p>Coda {0}</p><footer>Foot</footer></body>"
    assert texts(spark, [shell.format(i, b) for i, b in enumerate(body)]) == [f"Title {i} Lead {i} {b} Coda {i}" for i, b in enumerate(body)]


def test_names_that_only_look_like_menus(spark):
    prose = [f"Body {i} and more words here" for i in range(4)]
    for shell in (
        "<body class='has-sidebar'><h1 class='entry-header'>T{0}</h1><div class='content no-sidebar'><p>{1}</p></div><div class=side-bar>Aside</div></body>",
        "<body class=sidebar id=nav><h1>T{0}</h1><article class='post comments-open'><p>{1}</p></article></body>".replace("<h1>T{0}</h1><article class='post comments-open'>", "<article class='post comments-open'><h1>T{0}</h1>"),
        "<body><main id='main-side'><h1>T{0}</h1><p>{1}</p><div class='cookie-notice site-wide'>We use</div></main></body>",
        "<body><h1>T{0}</h1><div class=widget><p>{1}</p><div class='comment-list'>A reader</div></div></body>",
        "<body><h1>T{0}</h1><div class=box><p>{1}</p></div><div id='left-sidebar' class=x>Aside {0}</div><div class='ad-300x250'>Buy {0}</div><span class=share-buttons>Send {0}</span></body>",
    ):
        assert texts(spark, [shell.format(i, p) for i, p in enumerate(prose)]) == [f"T{i} {p}" for i, p in enumerate(prose)]


def test_threads_longer_than_the_text_stay_out(spark):
    shell = "<body><h1>T{0}</h1><p>Body {0}</p><div id=comment-list><p>" + "A reader says more " * 20 + "{0}</p></div></body>"
    assert texts(spark, [shell.format(i) for i in range(4)]) == [f"T{i} Body {i}" for i in range(4)]
