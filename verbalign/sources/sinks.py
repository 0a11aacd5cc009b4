"""Writing results: payload JSON, tables, subtitle files, pages and manifests.

``write_*_table`` go through Spark's writers and suit any size. The functions
that make one file per item are for items that a reader opens whole; they take
an item's rows, already rolled up by Spark, to the driver one item at a time.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape
from ..operators import review, segments

ASSET_MODES = ("link", "copy", "preview")


def write_json(payload: dict, path: str | Path) -> Path:
    """UTF-8, two spaces, a final line feed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return path


def write_json_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv_table(rows: DataFrame, path: str) -> None:
    """The 16 export columns with their item; quotes are doubled, missing values empty."""
    review.csv_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_visible_csv(rows: DataFrame, path: str) -> None:
    """Filtered rows as a spreadsheet reads them: all quoted, with a byte order mark in the first header."""
    out = review.csv_rows(rows)
    out = out.withColumnRenamed("media_id", "﻿media_id")
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_srt_table(segs: DataFrame, path: str) -> None:
    segments.render_srt(segs).write.mode("overwrite").parquet(path)


def payload_of(rows: DataFrame, summary: DataFrame, media_id: str, extra: dict | None = None) -> dict:
    """One item's result as a JSON object."""
    meta = summary.where(F.col("media_id") == media_id).drop("media_id").first()
    body = rows.where(F.col("media_id") == media_id).orderBy("id").drop("media_id").toJSON().collect()
    return {"metadata": {**(meta.asDict() if meta else {}), **(extra or {})}, "segments": [json.loads(x) for x in body]}


def write_transcription(segs: DataFrame, metadata: DataFrame, media_id: str, directory: str | Path) -> dict[str, Path]:
    """transcription.json, .srt and .txt of one item."""
    directory = Path(directory)
    directory.mkdir(parents=True, exist_ok=True)
    own = segs.where(F.col("media_id") == media_id)
    meta = metadata.where(F.col("media_id") == media_id)
    body = [json.loads(x) for x in own.orderBy("seq").drop("media_id", "seq").toJSON().collect()]
    paths = {k: directory / f"transcription.{x}" for k, x in (("json", "json"), ("srt", "srt"), ("text", "txt"))}
    write_json({"metadata": meta.drop("media_id").first().asDict(), "segments": body}, paths["json"])
    srt = segments.render_srt(own).first()
    paths["srt"].write_text(srt.srt if srt else "", encoding="utf-8")
    paths["text"].write_text(segments.render_text(own, meta).first().text, encoding="utf-8")
    return paths


#: Style, list and script of the report page. Placeholders are filled by ``str.replace``.
PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>@title@</title>
<style>body{font-family:sans-serif;margin:2em}ol{list-style:none;padding:0}li{border-top:1px solid #bbb;padding:.5em 0}li[data-status=REVIEW]{background:#fff4ec}
blockquote{display:inline-block;width:44%;vertical-align:top;margin:.3em 1%}dl{display:flex;flex-wrap:wrap;gap:.3em;margin:0;color:#555}dd{margin:0 .8em 0 0}output{margin:0 .8em;padding:0 .4em}
output.high,output.good{background:#d4f0dc}output.fair{background:#fbeecb}output.low{background:#f7d3d0}</style></head>
<body><h1>@title@</h1><p>@meta@</p><video id="player" controls @source@></video>
<form id="ask"><input name="find" placeholder="Search"> <select name="status"><option value="">any status<option>OK<option>REVIEW</select>
<select name="reason"><option value="">any reason@reasons@</select> score <input name="low" type="number" min="0" max="1" step="0.05" value="0"> to <input name="high" type="number" min="0" max="1" step="0.05" value="1">
sort by <select name="sort"><option value="at">time<option value="score">score<option value="status">status<option value="reason">reason</select> <label><input name="down" type="checkbox"> descending</label>
<label><input name="loop" type="checkbox"> repeat 4 s</label> speed <select name="rate"><option>0.5<option selected>1<option>1.5<option>2</select>
<button name="back" type="button">-5 s</button> <button name="on" type="button">+5 s</button> <button name="save" type="button">Save shown rows</button></form>
<ol id="rows">
@rows@
</ol>
<script>
const ask=document.forms.ask.elements,list=document.getElementById('rows'),player=document.getElementById('player');let from=0;
function arrange(){
  const seen=x=>x.dataset.search.includes(ask.find.value.trim().toLowerCase())&&(!ask.status.value||x.dataset.status===ask.status.value)
    &&(!ask.reason.value||x.dataset.reason===ask.reason.value)&&+x.dataset.score>=+ask.low.value&&+x.dataset.score<=+ask.high.value;
  const key=ask.sort.value,sign=ask.down.checked?-1:1,number=key==='at'||key==='score';
  const order=(a,b)=>sign*(number?a.dataset[key]-b.dataset[key]:a.dataset[key].localeCompare(b.dataset[key]))||a.dataset.at-b.dataset.at;
  [...list.children].sort(order).forEach(x=>{x.hidden=!seen(x);list.append(x);});
}
function save(){
  const quote=t=>'"'+t.replaceAll('"','""')+'"',shown=[...list.children].filter(x=>!x.hidden);
  const lines=shown.map(x=>[x.dataset.at,x.dataset.status,x.dataset.reason,x.dataset.score,...[...x.querySelectorAll('blockquote')].map(q=>q.textContent)].map(quote).join(','));
  const link=document.createElement('a');
  link.href=URL.createObjectURL(new Blob(['\\ufeff'+['"time","status","reason","score","speech","subtitle"',...lines].join('\\r\\n')],{type:'text/csv'}));
  link.download='rows.csv';link.click();
}
document.forms.ask.addEventListener('input',()=>{player.playbackRate=+ask.rate.value;arrange();});
ask.back.onclick=()=>{player.currentTime-=5;};ask.on.onclick=()=>{player.currentTime+=5;};ask.save.onclick=save;
list.addEventListener('click',e=>{const t=e.target.dataset.seek;if(t){from=+t;player.currentTime=from;player.play();}});
player.addEventListener('timeupdate',()=>{if(ask.loop.checked&&player.currentTime>from+4)player.currentTime=from;});
</script></body></html>
"""


def page_table(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """media_id, page: every item's report page, made where its rows are. The player has no source."""
    lines = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("id", review.row_html().alias("html")))).alias("lines"))
    head = review.header(summary)
    shown = F.format_string("%d segments | %d OK | %d to review | average %s", "segment_count", "ok_count", "flagged_count", "average")
    pages = head.join(lines, "media_id", "left").join(review.reasons(rows), "media_id", "left")
    page, filled = F.lit(PAGE), {
        "@title@": html_escape(F.col("media_id")), "@meta@": shown, "@source@": F.lit("hidden"),
        "@reasons@": F.concat_ws("", F.transform("reasons", lambda r: F.concat(F.lit("<option>"), html_escape(r)))),
        "@rows@": F.coalesce(F.array_join("lines.html", "\n"), F.lit("")),
    }
    for key, value in filled.items():
        page = F.replace(page, F.lit(key), value)
    return pages.select("media_id", page.alias("page"))


def write_pages(rows: DataFrame, summary: DataFrame, directory: str) -> None:
    """All items' pages below ``directory``, one file for each, written by the executors."""
    from ..functions.text import output_stem

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(directory if "://" in directory or directory.startswith("file:") else f"file://{os.path.abspath(directory)}")
        system.create_dir(root, recursive=True)
        for b in batches:
            for name, page in zip(b.name, b.page):
                with system.open_output_stream(f"{root}/{name}.html") as f:
                    f.write(page.encode("utf-8"))
            yield pd.DataFrame({"n": [len(b)]})

    # items of one name in different folders get a digest of their path
    named = page_table(rows, summary).withColumn("stem", output_stem(F.col("media_id")))
    twice = named.groupBy("stem").count().where("count > 1").select("stem", F.lit(True).alias("twice"))
    name = F.when(F.col("twice"), F.concat("stem", F.lit("_"), F.left(F.sha2("media_id", 256), F.lit(8)))).otherwise(F.col("stem"))
    named.join(twice, "stem", "left").select(name.alias("name"), "page").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def render_page(rows: DataFrame, summary: DataFrame, media_id: str, video: str | None = None, asset_mode: str = "link") -> str:
    """The report page of one item; its rows and cells are made by Spark."""
    import html

    if asset_mode not in ASSET_MODES:
        raise ValueError(f"unknown asset mode {asset_mode!r}; one of {ASSET_MODES}")
    own = page_table(rows.where(F.col("media_id") == media_id), summary.where(F.col("media_id") == media_id)).first()
    page = own.page if own else PAGE.replace("@title@", html.escape(media_id)).replace("@meta@", "no segments").replace("@reasons@", "").replace("@rows@", "").replace("@source@", "hidden")
    return page.replace('controls hidden>', f'controls src="{html.escape(video, quote=True)}">') if video else page


def write_page(rows: DataFrame, summary: DataFrame, media_id: str, path: str | Path, video: str | None = None, asset_mode: str = "link") -> Path:
    import shutil

    path = Path(path)
    text_video = video
    path.parent.mkdir(parents=True, exist_ok=True)
    if video and not video.startswith(("http:", "https:")) and Path(video).exists():
        if asset_mode in ("copy", "preview"):
            (path.parent / "assets").mkdir(exist_ok=True)
            text_video = f"assets/{Path(video).name}"
            shutil.copyfile(video, path.parent / text_video)
        else:
            text_video = os.path.relpath(video, path.parent)
    path.write_text(render_page(rows, summary, media_id, text_video, asset_mode), encoding="utf-8")
    return path


def write_manifest(path: str | Path, metadata: dict, artifacts: dict) -> Path:
    return write_json({"metadata": metadata, "artifacts": {k: str(v) for k, v in artifacts.items()}}, path)
