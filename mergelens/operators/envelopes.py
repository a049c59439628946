"""Reply envelopes of three kinds of model services, to one flat shape and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelens.functions import text as X

MESSAGES = "id string, type string, role string, content array<struct<type:string,text:string>>, model string, stop_reason string, usage struct<input_tokens:int,output_tokens:int>"
CHAT = "id string, model string, choices array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"
GENERATE = "candidates array<struct<content:struct<role:string,parts:array<struct<text:string>>>,finishReason:string>>, usageMetadata struct<promptTokenCount:int,candidatesTokenCount:int,totalTokenCount:int>"

#: The common shape.
REPLY = "struct<content:string,model:string,provider:string,input_tokens:int,output_tokens:int,total_tokens:int>"


def _reply(content: Column, model: Column, provider: str, n_in: Column, n_out: Column, total: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    reply = F.struct(content.alias("content"), model.alias("model"), F.lit(provider).alias("provider"), zero(n_in).alias("input_tokens"), zero(n_out).alias("output_tokens"), zero(total).alias("total_tokens"))
    return F.when(content.isNotNull(), reply)


def from_messages(body: Column, provider: str = "claude") -> Column:
    """First block of type text; the total is input plus output. Null without such a block, or if malformed."""

    def read(e: Column) -> Column:
        text = F.try_element_at(F.filter(e["content"], lambda b: b["type"] == "text"), F.lit(1))["text"]
        n_in, n_out = e["usage"]["input_tokens"], e["usage"]["output_tokens"]
        return _reply(text, e["model"], provider, n_in, n_out, n_in + n_out)

    return X.let(F.from_json(body, MESSAGES), read)


def from_chat(body: Column, provider: str = "openai") -> Column:
    """First choice; absent usage counts 0."""

    def read(e: Column) -> Column:
        text = F.try_element_at(e["choices"], F.lit(1))["message"]["content"]
        return _reply(text, e["model"], provider, e["usage"]["prompt_tokens"], e["usage"]["completion_tokens"], e["usage"]["total_tokens"])

    return X.let(F.from_json(body, CHAT), read)


def from_generate(body: Column, model: Column, provider: str = "gemini") -> Column:
    """First part of the first candidate; the model is the configured one."""

    def read(e: Column) -> Column:
        part = F.try_element_at(F.try_element_at(e["candidates"], F.lit(1))["content"]["parts"], F.lit(1))["text"]
        usage = e["usageMetadata"]
        return _reply(part, model, provider, usage["promptTokenCount"], usage["candidatesTokenCount"], usage["totalTokenCount"])

    return X.let(F.from_json(body, GENERATE), read)


def normalise(kind: Column, body: Column, configured_model: Column) -> Column:
    """The common shape by ``kind``: messages, chat or generate."""
    return F.when(kind == "messages", from_messages(body)).when(kind == "chat", from_chat(body)).when(kind == "generate", from_generate(body, configured_model))


def messages_request(model: Column, system: Column, user: Column, max_tokens: Column, temperature: Column) -> Column:
    turns = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.to_json(F.struct(model.alias("model"), max_tokens.alias("max_tokens"), system.alias("system"), turns.alias("messages"), temperature.alias("temperature"), F.lit(False).alias("stream")))


def chat_request(model: Column, system: Column, user: Column, max_tokens: Column, temperature: Column) -> Column:
    turns = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.to_json(F.struct(model.alias("model"), turns.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens"), F.lit(False).alias("stream")))


def generate_request(system: Column, user: Column, max_tokens: Column, temperature: Column) -> Column:
    part = lambda c: F.array(F.struct(c.alias("text")))
    turns = F.array(F.struct(F.lit("user").alias("role"), part(user).alias("parts")))
    return F.to_json(F.struct(turns.alias("contents"), F.struct(part(system).alias("parts")).alias("systemInstruction"), F.struct(temperature.alias("temperature"), max_tokens.alias("maxOutputTokens")).alias("generationConfig")))
