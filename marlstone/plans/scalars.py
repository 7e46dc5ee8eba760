"""Scalar functions, one query for each name, over a table's columns or over given values."""

from __future__ import annotations

from marlstone.plans.registry import both

#: Over columns: table and key, then name -> (Spark, DuckDB where it differs).
OVER = {
    ("events", "event_id"): {
        "abs": ("abs(value - 20)", None), "ceil": ("ceil(value)", "CAST(ceil(value) AS BIGINT)"), "floor": ("floor(value)", "CAST(floor(value) AS BIGINT)"), "sqrt": ("round(sqrt(value), 8)", None), "cbrt": ("round(cbrt(value), 8)", None),
        "exp": ("round(exp(value / 100), 8)", None), "ln": ("round(ln(value + 1), 8)", None), "log": ("round(log(2, value + 1), 8)", None), "log10": ("round(log10(value + 1), 8)", None), "log2": ("round(log2(value + 1), 8)", None),
        "sin": ("round(sin(value), 8)", None), "cos": ("round(cos(value), 8)", None), "tan": ("round(tan(value / 1000), 8)", None), "cot": ("round(cot(value + 1), 4)", None), "asin": ("round(asin(value / 1000000), 8)", None), "acos": ("round(acos(value / 1000000), 8)", None), "atan2": ("round(atan2(value, 3), 8)", None), "atan": ("round(atan(value), 8)", None),
        "degrees": ("round(degrees(value), 6)", None), "radians": ("round(radians(value), 8)", None), "pow": ("round(pow(value, 2), 4)", None), "signum": ("signum(value - 20)", "CAST(sign(value - 20) AS DOUBLE)"), "pi": ("round(pi() * value, 6)", None),
        "round": ("round(value, 1)", None), "round_negative": ("round(event_id, -2)", "CAST(floor((event_id + 50) / 100) * 100 AS BIGINT)"), "bround": ("bround(user_id / 2.0D, 0)", "round_even(user_id / 2.0, 0)"), "mod": ("mod(event_id, 7)", None), "pmod": ("pmod(-event_id, 7)", "CASE WHEN event_id % 7 = 0 THEN 0 ELSE 7 - event_id % 7 END"), "negative": ("negative(value)", "-value"), "positive": ("positive(value)", "value"),
        "bin": ("bin(event_id)", "bin(event_id)"), "hex": ("hex(event_id)", "hex(event_id)"), "bit_count": ("bit_count(event_id)", "CAST(bit_count(event_id) AS INTEGER)"), "getbit": ("getbit(event_id, 3)", "CAST((event_id >> 3) & 1 AS TINYINT)"), "shiftleft": ("shiftleft(event_id, 3)", "event_id << 3"), "shiftright": ("shiftright(event_id, 2)", "event_id >> 2"), "shiftrightunsigned": ("shiftrightunsigned(event_id, 2)", "event_id >> 2"), "bit_operators": ("(event_id & 12) | (event_id ^ 5)", "(event_id & 12) | xor(event_id, 5)"),
        "factorial": ("factorial(CAST(event_id % 20 AS INT))", "CAST(factorial(CAST(event_id % 20 AS INTEGER)) AS BIGINT)"), "try_add": ("try_add(event_id, 9223372036854775000)", "CASE WHEN event_id <= 807 THEN event_id + 9223372036854775000 END"), "try_divide": ("round(try_divide(value, user_id % 3), 8)", "CASE WHEN user_id % 3 <> 0 THEN round(value / (user_id % 3), 8) END"), "try_subtract": ("try_subtract(-event_id, 9223372036854775800)", "CASE WHEN event_id <= 8 THEN -event_id - 9223372036854775800 END"), "try_multiply": ("try_multiply(event_id, 9223372036854775807)", "CASE WHEN event_id = 0 THEN 0 WHEN event_id = 1 THEN 9223372036854775807 END"), "try_mod": ("try_mod(event_id, user_id % 2)", "CASE WHEN user_id % 2 <> 0 THEN event_id % (user_id % 2) END"),
        "nullifzero": ("nullifzero(user_id % 4)", "nullif(user_id % 4, 0)"), "zeroifnull": ("zeroifnull(nullif(user_id, 3))", "coalesce(nullif(user_id, 3), 0)"), "if": ("if(value > 5, 'a', 'b')", None), "iff_lazy": ("if(user_id = 0, -1D, value / nullif(user_id, 0))", "CASE WHEN user_id = 0 THEN -1.0 ELSE value / nullif(user_id, 0) END"),
        "coalesce": ("coalesce(nullif(user_id, 1), -5)", None), "nullif": ("nullif(event_type, 'view')", None), "nvl": ("nvl(nullif(event_type, 'view'), 'x')", "coalesce(nullif(event_type, 'view'), 'x')"), "nvl2": ("nvl2(nullif(event_type, 'view'), 1, 2)", "CASE WHEN event_type <> 'view' THEN 1 ELSE 2 END"), "ifnull": ("ifnull(nullif(user_id, 1), 0)", None), "greatest": ("greatest(event_id, user_id, 50)", None), "least": ("least(event_id, user_id, 50)", None), "nanvl": ("nanvl(CASE WHEN event_id % 2 = 0 THEN DOUBLE('NaN') ELSE value END, -1D)", "CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE value END"),
        "cast_family": ("concat_ws('|', string(event_id), int(value), bigint(value), boolean(user_id), date(ts))", "concat_ws('|', event_id, CAST(trunc(value) AS INTEGER), CAST(trunc(value) AS BIGINT), CASE WHEN user_id <> 0 THEN 'true' ELSE 'false' END, CAST(ts AS DATE))"), "cast_decimal": ("CAST(CAST(value AS DECIMAL(12, 2)) AS STRING)", "CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR)"), "try_cast": ("try_cast(event_type AS INT)", "CAST(NULL AS INTEGER)"), "typeof": ("typeof(event_id)", "'bigint'"), "width_bucket": ("width_bucket(value, 0, 100, 10)", "CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT)"),
        "year": ("year(ts)", "CAST(year(ts) AS INTEGER)"), "month": ("month(ts)", "CAST(month(ts) AS INTEGER)"), "dayofmonth": ("dayofmonth(ts)", "CAST(day(ts) AS INTEGER)"), "dayofweek": ("dayofweek(ts)", "CAST(dayofweek(ts) + 1 AS INTEGER)"), "dayofyear": ("dayofyear(ts)", "CAST(dayofyear(ts) AS INTEGER)"), "weekofyear": ("weekofyear(ts)", "CAST(weekofyear(ts) AS INTEGER)"), "quarter": ("quarter(ts)", "CAST(quarter(ts) AS INTEGER)"), "hour": ("hour(ts)", "CAST(hour(ts) AS INTEGER)"), "minute": ("minute(ts)", "CAST(minute(ts) AS INTEGER)"), "second": ("second(ts)", "CAST(second(ts) AS INTEGER)"), "weekday": ("weekday(ts)", "CAST((dayofweek(ts) + 6) % 7 AS INTEGER)"),
        "extract": ("extract(hour FROM ts)", "CAST(extract(hour FROM ts) AS INTEGER)"), "date_part": ("date_part('minute', ts)", "CAST(date_part('minute', ts) AS INTEGER)"), "date_trunc": ("CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ)", "date_trunc('hour', ts)"), "trunc": ("trunc(CAST(ts AS DATE), 'MM')", "CAST(date_trunc('month', ts) AS DATE)"), "date_add": ("date_add(CAST(ts AS DATE), 40)", "CAST(CAST(ts AS DATE) + 40 AS DATE)"), "date_sub": ("date_sub(CAST(ts AS DATE), 40)", "CAST(CAST(ts AS DATE) - 40 AS DATE)"), "datediff": ("datediff(CAST(ts AS DATE), DATE '2023-12-25')", "CAST(CAST(ts AS DATE) - DATE '2023-12-25' AS INTEGER)"), "add_months": ("add_months(CAST(ts AS DATE), 1)", "CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE)"), "last_day": ("last_day(CAST(ts AS DATE))", "last_day(CAST(ts AS DATE))"),
        "next_day": ("next_day(CAST(ts AS DATE), 'MON')", "CAST(CAST(ts AS DATE) + CAST(CASE WHEN dayofweek(ts) = 0 THEN 1 ELSE 8 - dayofweek(ts) END AS INTEGER) AS DATE)"), "date_format": ("date_format(ts, 'yyyy/MM/dd HH:mm')", "strftime(ts, '%Y/%m/%d %H:%M')"), "interval_arithmetic": ("ts + INTERVAL '36' HOUR", None), "make_date": ("make_date(year(ts), month(ts), 1)", "CAST(date_trunc('month', ts) AS DATE)"), "to_date": ("to_date(date_format(ts, 'yyyy-MM-dd'))", "CAST(ts AS DATE)"), "unix_seconds": ("unix_seconds(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"), "unix_millis": ("unix_millis(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"), "unix_micros": ("unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"), "unix_date": ("unix_date(CAST(ts AS DATE))", "CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER)"), "date_from_unix_date": ("date_from_unix_date(CAST(user_id AS INT))", "CAST(DATE '1970-01-01' + CAST(user_id AS INTEGER) AS DATE)"),
        "unix_timestamp": ("unix_timestamp(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"), "to_unix_timestamp": ("to_unix_timestamp(date_format(ts, 'yyyy-MM-dd'), 'yyyy-MM-dd')", "CAST(epoch(CAST(ts AS DATE)) AS BIGINT)"), "from_unixtime": ("from_unixtime(user_id * 86400)", "strftime(make_timestamp(user_id * 86400000000), '%Y-%m-%d %H:%M:%S')"), "timestamp_seconds": ("CAST(timestamp_seconds(user_id) AS TIMESTAMP_NTZ)", "make_timestamp(user_id * 1000000)"), "timestamp_millis": ("CAST(timestamp_millis(event_id) AS TIMESTAMP_NTZ)", "make_timestamp(event_id * 1000)"), "timestamp_micros": ("CAST(timestamp_micros(event_id) AS TIMESTAMP_NTZ)", "make_timestamp(event_id)"), "make_timestamp": ("CAST(make_timestamp(2024, 1, 2, 3, 4, CAST(user_id % 60 AS DECIMAL(8, 6))) AS TIMESTAMP_NTZ)", "make_timestamp(2024, 1, 2, 3, 4, CAST(user_id % 60 AS DOUBLE))"), "make_timestamp_ntz": ("make_timestamp_ntz(2024, 1, 2, 3, 4, CAST(user_id % 60 AS DECIMAL(8, 6)))", "make_timestamp(2024, 1, 2, 3, 4, CAST(user_id % 60 AS DOUBLE))"), "to_timestamp": ("CAST(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm'), 'yyyy-MM-dd HH:mm') AS TIMESTAMP_NTZ)", "date_trunc('minute', ts)"), "to_timestamp_ntz": ("to_timestamp_ntz(date_format(ts, 'yyyy-MM-dd HH:mm:ss'))", "date_trunc('second', ts)"), "try_to_timestamp": ("CAST(try_to_timestamp(event_type) AS TIMESTAMP_NTZ)", "CAST(NULL AS TIMESTAMP)"), "timestampdiff": ("timestampdiff(DAY, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)", "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000) AS BIGINT)"),
        "get_json_object": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), "from_json": ("from_json(props, 'k INT').k", "CAST(json_extract(props, '$.k') AS INTEGER)"), "to_json": ("to_json(named_struct('u', user_id, 't', event_type))", "concat('{\"u\":', user_id, ',\"t\":\"', event_type, '\"}')"), "json_object_keys": ("array_join(json_object_keys(props), ',')", "'k'"), "json_array_length": ("json_array_length(concat('[1,2,', user_id, ']'))", "3"), "to_csv": ("to_csv(named_struct('a', event_id, 'b', event_type))", "concat(event_id, ',', event_type)"), "from_csv": ("from_csv(concat(event_id, ',', event_type), 'a BIGINT, b STRING').a", "event_id"), "schema_of_json": ("schema_of_json('{\"k\": 1}')", "'STRUCT<k: BIGINT>'"), "parse_json": ("variant_get(parse_json(props), '$.k', 'int')", "CAST(json_extract(props, '$.k') AS INTEGER)"),
        "array": ("array(event_id, user_id)", "[event_id, user_id]"), "array_size": ("array_size(array(1, 2, user_id))", "3"), "size": ("size(sequence(0, user_id % 5))", "CAST(user_id % 5 + 1 AS INTEGER)"), "sort_array": ("sort_array(array(user_id, 7, event_id), false)", "list_reverse_sort([user_id, 7, event_id])"), "array_sort": ("array_sort(array(user_id, 7, event_id))", "list_sort([user_id, 7, event_id])"), "array_contains": ("array_contains(array(1, 2, 3), user_id)", "user_id IN (1, 2, 3)"), "array_distinct": ("size(array_distinct(array(user_id, 7, 7)))", "CASE WHEN user_id = 7 THEN 1 ELSE 2 END"), "array_union": ("array_sort(array_union(array(1L, 2L), array(user_id)))", "list_sort(list_distinct([1, 2, user_id]))"), "array_intersect": ("array_intersect(array(1L, 2L, 3L), array(user_id, 3L))", "CASE WHEN user_id IN (1, 2) THEN [user_id, 3] ELSE [CAST(3 AS BIGINT)] END"), "array_except": ("array_except(array(1L, 2L, 3L), array(user_id))", "list_filter([CAST(1 AS BIGINT), 2, 3], lambda x: x <> user_id)"), "array_position": ("array_position(array(5, 6, 7), user_id)", "CAST(coalesce(list_position([5, 6, 7], user_id), 0) AS BIGINT)"), "arrays_overlap": ("arrays_overlap(array(1L, 2L), array(user_id))", "user_id IN (1, 2)"), "array_join": ("array_join(array(event_type, 'x'), '-')", "concat(event_type, '-x')"), "array_insert": ("array_insert(array(1L, 2L), 2, user_id)", "[1, user_id, 2]"), "array_compact": ("array_compact(array(nullif(user_id, 1), 2L))", "list_filter([nullif(user_id, 1), 2], lambda x: x IS NOT NULL)"), "array_append": ("array_append(array(1L), user_id)", "[1, user_id]"), "array_prepend": ("array_prepend(array(1L), user_id)", "[user_id, 1]"), "arrays_zip": ("arrays_zip(array(user_id), array(event_id))[0]['1']", "event_id"), "element_at": ("element_at(array(user_id, event_id), -1)", "event_id"), "try_element_at": ("try_element_at(array(user_id), 3)", "CAST(NULL AS BIGINT)"), "slice": ("slice(array(1L, user_id, 3L), 2, 2)", "[user_id, 3]"), "array_remove": ("array_remove(array(1L, 2L), user_id)", "list_filter([CAST(1 AS BIGINT), 2], lambda x: x <> user_id)"), "array_repeat": ("array_repeat(user_id, 2)", "[user_id, user_id]"), "flatten": ("flatten(array(array(user_id), array(event_id)))", "[user_id, event_id]"), "array_min_max": ("array_max(array(user_id, event_id)) - array_min(array(user_id, event_id))", "abs(user_id - event_id)"),
        "transform": ("transform(array(1L, user_id), x -> x * 2)", "[2, user_id * 2]"), "filter": ("filter(array(1L, user_id), x -> x > 1)", "list_filter([1, user_id], lambda x: x > 1)"), "exists": ("exists(array(1L, user_id), x -> x = 9)", "user_id = 9"), "forall": ("forall(array(1L, user_id), x -> x < 100)", "user_id < 100"), "aggregate": ("aggregate(array(1L, user_id), 0L, (a, x) -> a + x)", "user_id + 1"), "reduce": ("reduce(array(2L, user_id), 1L, (a, x) -> a * x)", "user_id * 2"), "zip_with": ("zip_with(array(user_id), array(event_id), (x, y) -> x + y)", "[user_id + event_id]"), "map": ("map('a', user_id)['a']", "user_id"), "map_contains_key": ("map_contains_key(map('a', 1), event_type)", "false"), "map_keys_values": ("concat(map_keys(map(event_type, 1))[0], map_values(map(1, event_type))[0])", "concat(event_type, event_type)"), "transform_keys": ("map_keys(transform_keys(map(user_id, 1), (k, v) -> k + v))", "[user_id + 1]"), "transform_values": ("map_values(transform_values(map(1, user_id), (k, v) -> k + v))", "[user_id + 1]"), "map_filter": ("size(map_filter(map(1L, user_id), (k, v) -> v > 50))", "CASE WHEN user_id > 50 THEN 1 ELSE 0 END"), "map_zip_with": ("map_zip_with(map(1, user_id), map(1, event_id), (k, a, b) -> a + b)[1]", "user_id + event_id"), "str_to_map": ("str_to_map(concat('a:', user_id))['a']", "CAST(user_id AS VARCHAR)"), "map_concat": ("map_concat(map('a', user_id), map('b', event_id))['b']", "event_id"), "named_struct": ("named_struct('a', user_id).a", "user_id"), "struct": ("struct(user_id, event_id).event_id", "event_id"),
        "md5": ("md5(event_type)", None), "sha2": ("sha2(event_type, 256)", "sha256(event_type)"), "sha1": ("sha1(event_type)", None), "base64": ("base64(event_type)", "base64(encode(event_type))"), "unbase64": ("decode(unbase64(base64(event_type)), 'UTF-8')", "event_type"), "encode": ("hex(encode(event_type, 'UTF-8'))", "hex(event_type)"), "decode": ("decode(encode(event_type, 'UTF-8'), 'UTF-8')", "event_type"), "unhex": ("decode(unhex(hex(event_type)), 'UTF-8')", "event_type"), "to_binary": ("hex(to_binary(event_type, 'utf-8'))", "hex(event_type)"), "conv": ("conv(event_id, 10, 16)", "hex(event_id)"), "assert_true": ("assert_true(value IS NOT NULL) IS NULL", "true"), "current_names": ("concat(current_catalog(), '.', current_database(), '.', current_schema())", "'spark_catalog.default.default'"), "now": ("now() >= TIMESTAMP '2024-01-01' AND current_date() > DATE '2024-01-01' AND current_timestamp() = now()", "true"),
    },
    ("part", "p_partkey"): {
        "concat": ("concat(p_name, ':', p_brand)", None), "concat_ws": ("concat_ws('-', p_name, p_type)", None), "upper": ("upper(p_name)", None), "lower": ("lower(p_brand)", None), "ucase": ("ucase(p_name)", "upper(p_name)"), "lcase": ("lcase(p_brand)", "lower(p_brand)"), "trim": ("trim(concat('  ', p_name, ' '))", None), "ltrim": ("ltrim(concat('  ', p_name))", None), "rtrim": ("rtrim(concat(p_name, '  '))", None), "btrim": ("btrim(p_name, 'rs')", "trim(p_name, 'rs')"), "lpad": ("lpad(p_name, 20, '*')", None), "rpad": ("rpad(p_name, 20, '*')", None), "substring": ("substring(p_name, 3, 4)", None), "substr": ("substr(p_name, 2)", None), "left": ("left(p_name, 3)", None), "right": ("right(p_name, 3)", None), "position": ("position('r' IN p_name)", "CAST(position('r' IN p_name) AS INTEGER)"), "split_part": ("split_part(p_name, ' ', 2)", None), "contains": ("contains(p_name, 'ing')", None), "length": ("length(p_name)", "CAST(length(p_name) AS INTEGER)"), "char_length": ("char_length(p_name)", "CAST(length(p_name) AS INTEGER)"), "octet_length": ("octet_length(p_name)", "CAST(strlen(p_name) AS INTEGER)"), "bit_length": ("bit_length(p_name)", "CAST(8 * strlen(p_name) AS INTEGER)"), "len": ("len(p_name)", "CAST(length(p_name) AS INTEGER)"), "repeat": ("repeat(p_type, 2)", None), "instr": ("instr(p_name, 'e')", "CAST(instr(p_name, 'e') AS INTEGER)"), "locate": ("locate('e', p_name)", "CAST(instr(p_name, 'e') AS INTEGER)"), "translate": ("translate(p_name, 'aeiou', 'AEIOU')", None), "initcap": ("initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"), "chr": ("chr(65 + p_size % 26)", "chr(CAST(65 + p_size % 26 AS INTEGER))"), "char": ("char(65 + p_size % 26)", "chr(CAST(65 + p_size % 26 AS INTEGER))"), "levenshtein": ("levenshtein(p_name, 'red ring')", "CAST(levenshtein(p_name, 'red ring') AS INTEGER)"), "overlay": ("overlay(p_name PLACING '__' FROM 2 FOR 3)", "concat(left(p_name, 1), '__', substring(p_name, 5))"), "ascii": ("ascii(p_name)", "CAST(ascii(p_name) AS INTEGER)"), "reverse": ("reverse(p_name)", None), "replace": ("replace(p_name, 'e', 'E')", None), "startswith": ("startswith(p_name, 'red')", "starts_with(p_name, 'red')"), "endswith": ("endswith(p_name, 'g')", "ends_with(p_name, 'g')"), "elt": ("elt(1 + p_size % 2, p_name, p_brand)", "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END"), "split": ("split(p_name, ' ')", "string_split(p_name, ' ')"), "split_limit": ("size(split(p_name, '[aeiou]', 2))", "CASE WHEN regexp_matches(p_name, '[aeiou]') THEN 2 ELSE 1 END"), "format_string": ("format_string('%s/%05d', p_name, p_size)", "format('{}/{:05d}', p_name, p_size)"), "substring_index": ("substring_index(p_name, ' ', 1)", "string_split(p_name, ' ')[1]"), "find_in_set": ("find_in_set(p_type, 'SMALL,LARGE,PROMO')", "CAST(coalesce(list_position(['SMALL', 'LARGE', 'PROMO'], p_type), 0) AS INTEGER)"), "mask": ("mask(p_brand)", "regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"), "to_number": ("CAST(to_number(CAST(p_size AS STRING), '99') AS INT)", "p_size"), "try_to_number": ("try_to_number(p_name, '99')", "CAST(NULL AS DECIMAL(2, 0))"), "to_char": ("to_char(p_size, '099')", "lpad(CAST(p_size AS VARCHAR), 3, '0')"), "to_varchar": ("to_varchar(p_size, '099')", "lpad(CAST(p_size AS VARCHAR), 3, '0')"), "format_number": ("format_number(p_retailprice, 2)", "format('{:,.2f}', p_retailprice)"),
        "regexp_extract": ("regexp_extract(p_brand, '#([0-9]+)', 1)", None), "regexp_substr": ("regexp_substr(p_name, '[aeiou]+')", "nullif(regexp_extract(p_name, '[aeiou]+'), '')"), "regexp_count": ("regexp_count(p_name, '[aeiou]')", "CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER)"), "regexp_instr": ("regexp_instr(p_name, 'i')", "CAST(instr(p_name, 'i') AS INTEGER)"), "regexp_like": ("regexp_like(p_name, '^r.*g$')", "regexp_matches(p_name, '^r.*g$')"), "rlike": ("p_name RLIKE 'b[lo]'", "regexp_matches(p_name, 'b[lo]')"), "regexp_extract_all": ("regexp_extract_all(p_name, '([aeiou])', 1)", "regexp_extract_all(p_name, '[aeiou]')"), "regexp_replace": ("regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), "similar_pattern": ("p_name REGEXP '(red|blue) '", "regexp_matches(p_name, '(red|blue) ')"),
    },
    ("pages", "page_id"): {
        "parse_url_host": ("parse_url(url, 'HOST')", "regexp_extract(url, '^https?://([^/?#]+)', 1)"), "parse_url_path": ("parse_url(url, 'PATH')", "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"), "parse_url_query": ("parse_url(url, 'QUERY')", "nullif(regexp_extract(url, '[?]([^#]*)', 1), '')"), "parse_url_protocol": ("parse_url(url, 'PROTOCOL')", "regexp_extract(url, '^([a-z]+):', 1)"), "url_encode": ("url_encode(url)", "replace(url_encode(url), '%20', '+')"), "url_decode": ("url_decode(url_encode(url))", "url"), "try_url_decode": ("try_url_decode('%zz')", "CAST(NULL AS VARCHAR)"),
        "octet_and_md5": ("concat(octet_length(html), md5(html))", "concat(strlen(html), md5(html))"), "html_text_length": ("length(regexp_replace(html, '<[^>]*>', ''))", "CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS INTEGER)"),
    },
}
for (_table, _key), _functions in OVER.items():
    for _name, (_spark, _duck) in _functions.items():
        both(f"fn_{_name}", _table, f"SELECT {_key}, {_spark} AS v FROM {_table}", f"SELECT {_key}, {_duck or _spark} AS v FROM {_table}")

#: Generators and table functions.
for _name, (_tables, _spark, _duck) in {
    "explode": ("events", "SELECT event_id, x FROM events LATERAL VIEW explode(sequence(1L, 1 + user_id % 3)) t AS x", "SELECT event_id, unnest(range(1, 2 + user_id % 3)) AS x FROM events"),
    "posexplode": ("part", "SELECT p_partkey, p, w FROM part LATERAL VIEW posexplode(split(p_name, ' ')) t AS p, w", "SELECT p_partkey, CAST(unnest(range(0, len(string_split(p_name, ' ')))) AS INTEGER) AS p, unnest(string_split(p_name, ' ')) AS w FROM part"),
    "inline": ("part", "SELECT p_partkey, a, b FROM part LATERAL VIEW inline(array(named_struct('a', p_size, 'b', 1), named_struct('a', p_size + 1, 'b', 2))) t AS a, b", "SELECT p_partkey, p_size AS a, 1 AS b FROM part UNION ALL SELECT p_partkey, p_size + 1, 2 FROM part"),
    "stack": ("part", "SELECT p_partkey, k, x FROM part LATERAL VIEW stack(2, 'a', p_name, 'b', p_brand) t AS k, x", "SELECT p_partkey, 'a' AS k, p_name AS x FROM part UNION ALL SELECT p_partkey, 'b', p_brand FROM part"),
    "range_tvf": ("", "SELECT id FROM range(5, 50, 5)", "SELECT range AS id FROM range(5, 50, 5)"),
    "pipe_sql": ("orders", "FROM orders |> WHERE o_totalprice > 450000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY o_orderstatus"),
}.items():
    both(f"generate_{_name}", _tables, _spark, _duck)
