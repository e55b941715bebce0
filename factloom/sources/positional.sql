SELECT doc_id,
  CASE
    WHEN doc_id % 9 = 0 THEN 'not json'
    ELSE concat(
      CASE WHEN doc_id % 9 = 1 THEN 'Odpověď: ' ELSE '' END,
      '{"results":[{"label":"Rodné číslo","value":"', regexp_extract(text, '[0-9]{6}/[0-9]{4}', 0),
      '","start":', CAST(instr(text, regexp_extract(text, '[0-9]{6}/[0-9]{4}', 0)) - 1 + CASE WHEN doc_id % 9 = 2 THEN 5 ELSE 0 END AS STRING),
      ',"end":', CAST(instr(text, regexp_extract(text, '[0-9]{6}/[0-9]{4}', 0)) + 10 + CASE WHEN doc_id % 9 = 2 THEN 5 WHEN doc_id % 9 = 3 THEN 100000 ELSE 0 END AS STRING),
      ',"confidence":0.9,"type":"birthNumber","context":""},{"label":"x","value":"ABSENT","start":1,"end":7,"confidence":0.9,"type":"t","context":""}]}')
  END AS raw_text
FROM contracts
