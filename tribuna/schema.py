"""Schemas, labels and colours that are the data contract."""

from __future__ import annotations

HEARING = "id string, transcricao string, metadados struct<assunto: string, envolvidos: array<struct<nome: string, cargo: string, opinioes: array<string>>>>"
STANCE = "id_audiencia string, assunto_audiencia string, nome string, cargo string, opiniao_limpa string, filiacao_rede string, proposicoes_audiencia string, proposicao_alvo string, postura_final string"

#: The stances, and the name of the totals.
FOR, AGAINST, NEUTRAL, FAILED = "A FAVOR", "CONTRA", "NEUTRO", "ERRO API"
VALID = (FOR, AGAINST, NEUTRAL)
TOTAL = "TOTAL_GERAL"
#: Fixed value: what stands in place of propositions where mining failed for good.
MINING_FAILED = "Erro: Falha persistente na API."
#: Roles that mark a speaker without a name.
ROLES = ("presidente", "vice presidente", "relator", "relatora", "secretario", "secretaria")
#: Colours of parties, and of all others.
COLOURS = {"PT": "#CC0000", "PL": "#222299", "NOVO": "#FF6600", "PSOL": "#FFCC00", "MDB": "#009933", "SOCIEDADE/OUTROS": "#888888"}
OTHER_COLOUR = "#AAAAAA"
#: Colours of edges by class.
EDGE_COLOURS = {"aliados": "rgba(0, 0, 255, 0.4)", "antagonistas": "rgba(255, 0, 0, 0.4)", "neutro": "rgba(169, 169, 169, 0.2)"}
