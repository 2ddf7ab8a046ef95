"""What is said of instances that fail and of schemas that can't be used, in words of this library."""

from __future__ import annotations

#: Keyword to what is said of an instance that fails it; {} stands for the keyword's value or a name.
FAILED = {
    "false": "nothing is allowed here",
    "$ref": "the reference leads nowhere",
    "allOf": "at least one schema of the list is not met",
    "anyOf": "no schema of the list is met",
    "oneOf none": "none of the schemas is met, one must be",
    "oneOf many": "{} schemas are met, only one may be",
    "not": "the schema under not is met",
    "dependentSchemas": "a schema that a present member calls for is not met",
    "prefixItems": "an item does not meet the schema of its position",
    "items": "an item does not meet the schema of all items",
    "contains": "no item meets the schema",
    "maxContains": "items that meet contains: at most {} wanted",
    "minContains": "items that meet contains: at least {} wanted",
    "properties": "a member does not meet its schema",
    "patternProperties": "a member does not meet the schema of a pattern that its name matches",
    "additionalProperties": "a further member does not meet its schema",
    "propertyNames": "a member's name does not meet the schema",
    "unevaluatedItems": "an item that no other keyword has looked at does not meet the schema",
    "unevaluatedProperties": "a member that no other keyword has looked at does not meet the schema",
    "type": "expected a value of type {}",
    "enum": "the value is not among those listed",
    "const": "the value differs from the constant",
    "multipleOf": "no multiple of {}",
    "maximum": "above the maximum of {}",
    "exclusiveMaximum": "not below {}",
    "minimum": "below the minimum of {}",
    "exclusiveMinimum": "not above {}",
    "maxLength": "longer than {} characters",
    "minLength": "shorter than {} characters",
    "pattern": "the string does not match the pattern",
    "maxItems": "more items than {}",
    "minItems": "fewer items than {}",
    "uniqueItems": "two items are equal",
    "maxProperties": "more members than {}",
    "minProperties": "fewer members than {}",
    "required": "member {} is missing",
    "dependentRequired": "member {} calls for member {}, which is missing",
}

#: What is wrong with a schema; {} stands for a keyword.
UNUSABLE = {
    "kind": "a schema must be an object, true or false",
    "dialect": "$schema names a dialect other than draft 2020-12",
    "text": "{} must be a string",
    "fragment": "$id must not carry a fragment",
    "id again": "two schemas share this $id",
    "anchor": "{} must be a name of letters, digits, '-', '_' and '.'",
    "anchor again": "two schemas of one resource share this {}",
    "list": "{} must be an array of at least one schema",
    "map": "{} must be an object whose members are schemas",
    "expression": "{} holds an expression that can't be read as ECMAScript (property escapes are not supported)",
    "type": "type must be the name of a type, or an array of such names",
    "type name": "type holds a name that is no type",
    "enum": "enum must be an array of at least one value",
    "number": "{} must be a number",
    "positive": "{} must be above 0",
    "count": "{} must be a whole number from 0 on",
    "boolean": "{} must be true or false",
    "names": "{} must be an array of strings",
    "map of names": "{} must be an object whose members are arrays of strings",
    "reference": "{} points to a schema that is not known",
    "itself": "{} points to the schema that it stands in",
    "loop": "following references comes back to this schema",
    "unnamed": "a referenced schema needs an $id or an alias",
}
