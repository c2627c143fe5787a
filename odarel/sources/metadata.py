"""The service document and the metadata document."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import types as T

from odarel.catalog import Catalog

# Primitive types of the protocol.
EDM = {
    T.StringType: "Edm.String", T.BooleanType: "Edm.Boolean", T.DoubleType: "Edm.Double", T.FloatType: "Edm.Single", T.ByteType: "Edm.SByte", T.ShortType: "Edm.Int16",
    T.IntegerType: "Edm.Int32", T.LongType: "Edm.Int64", T.TimestampType: "Edm.DateTimeOffset", T.TimestampNTZType: "Edm.DateTimeOffset", T.DateType: "Edm.Date",
    T.DayTimeIntervalType: "Edm.Duration", T.BinaryType: "Edm.Binary",
}


def edm(kind: T.DataType, namespace: str, owner: str) -> str:
    if isinstance(kind, T.ArrayType):
        return f"Collection({edm(kind.elementType, namespace, owner)})"
    if isinstance(kind, T.StructType):
        return f"{namespace}.{owner}"
    return "Edm.Decimal" if isinstance(kind, T.DecimalType) else EDM.get(type(kind), "Edm.String")


def service_document(catalog: Catalog, base: str, singletons: dict | None = None) -> dict:
    value = [{"name": s.name, "kind": "EntitySet", "url": s.name} for s in catalog]
    value += [{"name": n, "kind": "Singleton", "url": n} for n in singletons or {}]
    return {"@odata.context": f"{base}/$metadata", "value": value}


def metadata(catalog: Catalog, namespace: str = "Default", container: str = "DefaultContainer", singletons: dict | None = None, operations=()) -> dict:
    """CSDL as JSON."""
    schema: dict = {}
    sets: dict = {"$Kind": "EntityContainer"}
    for entity in catalog:
        frame = catalog.frame(entity.name)
        kind: dict = {"$Kind": "EntityType", "$Key": list(entity.keys)}
        if entity.base:
            kind["$BaseType"] = f"{namespace}.{entity.base}"
        for f in frame.schema.fields:
            owner = f"{entity.name}Type_{f.name}"
            prop: dict = {"$Type": edm(f.dataType, namespace, owner)}
            if f.name in entity.enums:
                prop["$Type"] = f"{namespace}.{owner}"
                schema[owner] = {"$Kind": "EnumType", **{str(v): i for i, v in enumerate(entity.enums[f.name])}}
            if f.nullable and f.name not in entity.keys:
                prop["$Nullable"] = True
            if isinstance(f.dataType, T.DecimalType):
                prop |= {"$Precision": f.dataType.precision, "$Scale": f.dataType.scale}
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                schema[owner] = {"$Kind": "ComplexType", **{x.name: {"$Type": edm(x.dataType, namespace, owner)} for x in inner.fields}}
            kind[f.name] = prop
        bindings = {}
        for r in entity.relations.values():
            many = r.kind != "one" or bool(r.through)
            kind[r.name] = {"$Kind": "NavigationProperty", "$Type": f"{namespace}.{catalog.get(r.target).name}Type"} | ({"$Collection": True} if many else {"$Nullable": True})
            bindings[r.name] = catalog.get(r.target).name
        schema[f"{entity.name}Type"] = kind
        sets[entity.name] = {"$Collection": True, "$Type": f"{namespace}.{entity.name}Type"} | ({"$NavigationPropertyBinding": bindings} if bindings else {})
    for name, (target, _) in (singletons or {}).items():
        sets[name] = {"$Type": f"{namespace}.{catalog.get(target).name}Type"}
    for op in operations:
        entry = {"$Kind": "Action" if op.writes else "Function", "$IsBound": op.binding != "unbound", "$Parameter": [{"$Name": n, "$Type": k.__name__} for n, k in op.params.items()]}
        schema.setdefault(op.name, []).append(entry)
    schema[container] = sets
    return {"$Version": "4.01", "$EntityContainer": f"{namespace}.{container}", namespace: schema}


def metadata_xml(catalog: Catalog, namespace: str = "Default", container: str = "DefaultContainer", **more) -> str:
    doc = metadata(catalog, namespace, container, **more)[namespace]
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<edmx:Edmx xmlns:edmx="http://docs.oasis-open.org/odata/ns/edmx" Version="4.0"><edmx:DataServices>', f'<Schema xmlns="http://docs.oasis-open.org/odata/ns/edm" Namespace={quoteattr(namespace)}>']
    for name, kind in doc.items():
        if isinstance(kind, list):
            for op in kind:
                params = "".join(f"<Parameter Name={quoteattr(p['$Name'])} Type={quoteattr(p['$Type'])}/>" for p in op["$Parameter"])
                out.append(f'<{op["$Kind"]} Name={quoteattr(name)} IsBound="{str(op["$IsBound"]).lower()}">{params}</{op["$Kind"]}>')
        elif kind["$Kind"] == "EntityType":
            base = f" BaseType={quoteattr(kind['$BaseType'])}" if "$BaseType" in kind else ""
            out.append(f"<EntityType Name={quoteattr(name)}{base}><Key>{''.join(f'<PropertyRef Name={quoteattr(k)}/>' for k in kind['$Key'])}</Key>")
            for prop, p in kind.items():
                if prop.startswith("$"):
                    continue
                if p.get("$Kind") == "NavigationProperty":
                    full = f"Collection({p['$Type']})" if p.get("$Collection") else p["$Type"]
                    out.append(f"<NavigationProperty Name={quoteattr(prop)} Type={quoteattr(full)}/>")
                else:
                    out.append(f'<Property Name={quoteattr(prop)} Type={quoteattr(p["$Type"])} Nullable="{str(p.get("$Nullable", False)).lower()}"/>')
            out.append("</EntityType>")
        elif kind["$Kind"] == "ComplexType":
            out.append(f"<ComplexType Name={quoteattr(name)}>{''.join(f'<Property Name={quoteattr(k)} Type={quoteattr(v['$Type'])}/>' for k, v in kind.items() if not k.startswith('$'))}</ComplexType>")
        elif kind["$Kind"] == "EnumType":
            out.append(f"<EnumType Name={quoteattr(name)}>{''.join(f'<Member Name={quoteattr(k)} Value="{v}"/>' for k, v in kind.items() if not k.startswith('$'))}</EnumType>")
        else:
            out.append(f"<EntityContainer Name={quoteattr(name)}>")
            for s, v in kind.items():
                if s.startswith("$"):
                    continue
                out.append(f"<EntitySet Name={quoteattr(s)} EntityType={quoteattr(v['$Type'])}>{''.join(f'<NavigationPropertyBinding Path={quoteattr(p)} Target={quoteattr(t)}/>' for p, t in v.get('$NavigationPropertyBinding', {}).items())}</EntitySet>" if v.get("$Collection") else f"<Singleton Name={quoteattr(s)} Type={quoteattr(v['$Type'])}/>")
            out.append("</EntityContainer>")
    return "".join([*out, "</Schema></edmx:DataServices></edmx:Edmx>"])
