"""Documents labelled by hand, by reading them: doc_id of the test tables at scale 0.1, for the training of the quality rules.

As a command it trains the rules from the tables in a directory and writes them.
"""

from __future__ import annotations

_IDS = {
    "junk": """
        292 348 387 423 524 711 767 801 963 1010 1123 1147 1259 1711 1940 2035 2238 2560 2655 2690 2892 2973 3075 3097 3120
        3156 3263 3280 3402 3556 3565 3578 3633 3948 4001 4044 6300 3429 8278 7248 6800 786 6907 4328 7594 718 10000 3269 7268 1420 962 4913 1523 3827 3128 9179 8104 2065 9745 2251 6288 4323 6372 2763 560 3697
        3298 472 4217 429 9043 6163 4690 9669 6454 7568 7070 2103 6669 6237 7622 5756 1279 8899 664 4161 3932 4467 6644 5025 1806 3910 8566 2388 2877 961 2397
        2055 3292 2539 9 15 33 57 64 105 198 257 279
    """,
    "table": """
        6909 5516 7006 1245 9397 7536 2814 556 3250 227 2218 1593 6025 5137 8670 7432 4200 7699 3764 3577 4612 8500 9771 3974 1857 4914 4246 4722 8207 8901
        8041 7925 4809 6133
    """,
    "list": """
        16 47 62 118 129 188 238 246 255 262 311 365 371 435 504 531 578 604 611 631 647 654 681 698 706 724
        9572 8852 4070 3864 4390 8471 7688 8720 5451 3949 9766 6362 7329 9830 7560 2709 9686 5820 8809 7922 7345 9303
    """,
    "prose": """
        18 117 125 173 200 224 314 315 379 484 496 520 522 613 626 652 661
        2604 9991 1814 7065 7971 2979 4660 9027 858 8173 491 9234 5289 545 558 1966 9969 7687 7285 3584 1547 8480 8093 532 2876 3555 8650 9140 7336 4420 3062
        2552 1273 6472 8289 6044 6538 5444 3092 2283 446 1383 4172 4478 7203 1763 1505 5488 6526 5375 1282 8630 6913 202 3210 6116 8741 1549 621 394 7127 9350
        3014 4334 896 7906 5707 7334 6467 2458 3544 8696 4846 363 3884 6410 2897 5021 9580 4749 2345 3999 1465 6560 3817 2946 1037 747 1777 5312 4123 6902
        3169 922 1444 8678 9502 7028 3857 8217 7610 2363 9200 1869 157
    """,
}
SEEDS = {int(i): kind for kind, ids in _IDS.items() for i in ids.split()}

#: Texts written by hand for forms of prose that the sample lacks: short sentences, one to a line.
PROSE = [
    "One two three. Four!\nFive six seven eight nine ten.", "It rained.", "We went home early.\nNobody saw us.\nIt was late.", "Why not?\nBecause we said so.", "Hello there!\nHow are you today?", "Das Haus ist alt.\nEs steht leer.",
    "Il pleut.\nNous restons ici.", "Она ушла.\nМы ждали.", "A short note. Read it.", "Thanks!\nSee you soon.", "No es verdad.\nYa veremos.", "Come here.\nSit down.\nListen to me.\nThen go.", "The end.",
]


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    from corpusloom.llm.quality import RULES, train
    from corpusloom.session import ship_package
    from corpusloom.sources.tables import table

    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    for rule in train(table(spark, sys.argv[1], "documents"), table(spark, sys.argv[1], "stopwords"), SEEDS, PROSE, path=RULES):
        print(rule)
