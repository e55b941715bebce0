SELECT o.o_orderkey AS doc_id,
  concat(
    'Smlouva č. ', CAST(o.o_orderkey AS STRING), '/2024', chr(10),
    'Prodávající: ', CASE WHEN o.o_custkey % 3 = 0 THEN 'Jan Novák' WHEN o.o_custkey % 3 = 1 THEN 'Marie Svobodová' ELSE 'Pavel Dvořák' END,
    ', rodné číslo: ',
    lpad(CAST(40 + o.o_custkey % 60 AS STRING), 2, '0'),
    lpad(CAST(1 + o.o_custkey % 13 + CASE WHEN o.o_orderkey % 2 = 0 THEN 50 ELSE 0 END AS STRING), 2, '0'),
    lpad(CAST(1 + o.o_custkey % 31 AS STRING), 2, '0'), '/',
    CAST(1000 + o.o_orderkey % 9000 AS STRING), chr(10),
    'telefon +420 ', CAST(600 + o.o_custkey % 200 AS STRING), ' ', CAST(100 + o.o_orderkey % 900 AS STRING), ' 456, IČO: ',
    CAST(10000000 + o.o_orderkey AS STRING), chr(10),
    'bydliště Dlouhá ', CAST(1 + o.o_custkey % 90 AS STRING), ', 110 00 Praha.', chr(10),
    CASE WHEN o.o_orderkey % 4 = 0 THEN '**Kupní cena** činí ' ELSE 'kupní cena činí ' END,
    CAST(CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS STRING), ' ',
    lpad(CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'),
    CASE WHEN o.o_orderkey % 2 = 0 THEN ' Kč' ELSE ' CZK' END, ', splatnost do ', CAST(1 + o.o_custkey % 60 AS STRING), ' dnů.', chr(10),
    'Účet ', CAST(10000000 + o.o_custkey AS STRING), '/0800, parcela č. ', CAST(1 + o.o_orderkey % 900 AS STRING), '/', CAST(1 + o.o_custkey % 90 AS STRING), '.', chr(10),
    'Datum: ', CAST(extract(DAY FROM o.o_orderdate) AS STRING), '. ', CAST(extract(MONTH FROM o.o_orderdate) AS STRING), '. ', CAST(extract(YEAR FROM o.o_orderdate) AS STRING), '.') AS text
FROM orders o
