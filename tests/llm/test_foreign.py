"""The pipeline's language stage: texts in no learnt language go, those of learnt languages stay."""

from tidemark.llm import langid

FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura",
    "Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą widzę i opisuję",
    "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan",
    "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra",
    "Мой дядя самых честных правил, когда не в шутку занемог, он уважать себя заставил и лучше выдумать не мог",
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所で泣いていた事だけは記憶している。",
    "xqzj kkwv zzpt qqxj wvkz jjqx ptkq zxvw kqjz vvxq jzkw qpxz wkjv bbqx zjjk wqvx kzpq xxjw",
]


def test_foreign_and_junk_go(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = spark.createDataFrame([(500_000 + i, x, None, "s", len(x)) for i, x in enumerate(FOREIGN)], some.schema)
    kept = {r.doc_id for r in langid.identified(some.unionByName(foreign)).collect()}
    assert not kept & {500_000 + i for i in range(len(FOREIGN))}
    clean = {r.doc_id for r in some.where("lang is not null and length(text) > 0").select("doc_id").collect()}
    assert len(kept & clean) >= 0.97 * len(clean)


def test_foreign_go_with_one_language(spark, sf_dir):
    english = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'")
    foreign = spark.createDataFrame([(500_000 + i, x, None, "s", len(x)) for i, x in enumerate(FOREIGN)], english.schema)
    kept = {r.doc_id for r in langid.identified(english.unionByName(foreign)).collect()}
    assert not [i for i in kept if i >= 500_000] and len(kept) >= 0.97 * english.count()
