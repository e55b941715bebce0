SELECT doc_id, 0 AS chunk_id,
  CASE
    WHEN doc_id % 11 = 0 THEN 'not json'
    WHEN doc_id % 11 = 1 THEN '{"results":[]}'
    WHEN doc_id % 11 = 2 THEN '{"results":[{"query":"rodné číslo","type":"single","value":""}]}'
    ELSE concat(
      '{"results":[{"query":"rodné číslo","type":"single","value":"', regexp_extract(text, '[0-9]{6}/[0-9]{4}', 0),
      '"},{"query":"všechny identifikátory","type":"multiple","values":[{"label":"Účet","value":"', regexp_extract(text, '[0-9]{8}/0800', 0),
      '"},{"label":"Datum","value":"', regexp_extract(text, '[0-9]+[.] [0-9]+[.] [0-9]{4}', 0), '"}]}]}')
  END AS raw_text
FROM contracts
